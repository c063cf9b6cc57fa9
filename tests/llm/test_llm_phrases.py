from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents

from venuesift.llm import phrases

LANGS = ("en", None, "de")


def plain(rows, min_count, most_words, top):
    """All phrases of all texts in dictionaries."""
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            found = re.findall("[^ \t]+", piece)
            words[lang] += len(found)
            for size in range(1, most_words + 1):
                for i in range(len(found) - size + 1):
                    counts[lang, tuple(found[i:i + size])] += 1
    out = []
    for lang in words:
        named = {p: f for (of, p), f in counts.items() if of == lang}
        candidates = {p: a for p, a in named.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in candidates.items():
            longer = [
                f for q, f in candidates.items() if len(q) > len(p)
                and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * f >= 80 * a for f in longer):
                continue
            score, _, left, right = min(
                (2_000_000 * a // (named[p[:k]] + named[p[k:]]), k, named[p[:k]], named[p[k:]]) for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def texts(seed, n=160):
    """Random words with fixed phrases in them, in pieces that end in all ways."""
    chance = random.Random(seed)
    words = ["a", "B", "ß", "É", "Über", "d'x", "中文", "g-h", "x y", "z\x1c", "\x00n", "k9"]
    fixed = ["New York City", "new york", "ice cream van man", "of the", "The end of"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(chance.randint(0, 30)):
            parts.append(chance.choice(fixed) if chance.random() < 0.3 else chance.choice(words))
            parts.append(chance.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", " ! ", "\r\n", "\x0b", "\x0c", ":", ";", "? "]))
        rows.append(("".join(parts), chance.choice(LANGS)))
    return rows


def mined(spark, rows, **options):
    docs = documents(spark, [(i, text) for i, (text, _) in enumerate(rows)]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (_, lang) in enumerate(rows)], "doc_id long, lang string")
    return sorted(map(tuple, phrases.collocations(docs.join(langs, "doc_id"), **options).collect()))


@pytest.mark.parametrize(("min_count", "sample_of", "top"), [(5, 8, 2000), (3, 2, 7), (30, 1, 2000)])
def test_equals_counting_everything(spark, min_count, sample_of, top):
    rows = texts(min_count)
    expected = plain(rows, min_count, 4, top)
    assert expected
    assert mined(spark, rows, min_count=min_count, sample_of=sample_of, top=top) == expected


def test_a_sample_that_proposes_nothing_is_made_good(spark):
    """No document falls into the sample, so every phrase comes from border failures."""
    rows = texts(11, 60)
    assert mined(spark, rows, min_count=4, sample_of=1 << 40) == plain(rows, 4, 4, 2000)


def test_more_keys_than_can_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(phrases, "KNOWN_KEYS", 3)
    rows = texts(12, 60)
    assert mined(spark, rows, min_count=4, sample_of=4) == plain(rows, 4, 4, 2000)


def test_many_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", 64)
    rows = texts(13, 60)
    assert mined(spark, rows, min_count=4, sample_of=4) == plain(rows, 4, 4, 2000)


def test_odd_texts(spark):
    rows = [(None, None), ("", "en"), (" \n\t.", "en"), *[("ice cream", "en")] * 7, ("ice cream " * 20_000, "en"), ("x", None)]
    found = mined(spark, rows, min_count=5)
    # Runs of one phrase overlap: the four-word phrase takes the others in.
    assert found == plain(rows, 5, 4, 2000)
    assert mined(spark, []) == []


def test_sums_beyond_64_bits(spark):
    """Counts near 2^63 are scored without overflow."""
    huge = 1 << 62
    rows = [("en", "a", 1, huge), ("en", "b", 1, huge), ("en", "a b", 2, huge)]
    frequent = spark.createDataFrame([(*row, 0) for row in rows], "lang string, phrase string, words int, f long, key long")
    totals = spark.createDataFrame([("en", 2 * huge - 1)], "lang string, n long")
    assert [tuple(r) for r in phrases.scored(frequent, totals, 10).collect()] == [
        ("en", 1, "a b", huge, huge, huge, 2 * huge - 1, 1_000_000)
    ]


def test_equal_keys_of_different_phrases_are_told_apart():
    keys = np.array([7, 7, 7, 9], dtype=np.uint64)
    words = [np.array([1, 2, 1, 3]), np.array([5, 5, 5, 5])]
    first, counts = phrases._distinct(keys, words)
    assert sorted(zip(words[0][first].tolist(), counts.tolist(), strict=True)) == [(1, 2), (2, 1), (3, 1)]


def test_rare_phrases_leave_a_task_only_as_keys():
    rows = [("en", f"ice cream van w{i} x{i} y{i}.".encode()) for i in range(50)] + [("de", b"ice cream van")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "data"])
    ranges = pa.Table.from_batches(list(phrases._key_counts(4, 2)(iter([batch]))))
    assert len(set(ranges["part"].to_pylist())) == 4
    keys = [
        phrases._summed(30)(ranges.filter(pa.array([p == part for p in ranges["part"].to_pylist()])))["key"].to_numpy()
        for part in range(4)
    ]
    table = np.zeros(1 << 21, np.uint8)
    for key in np.concatenate(keys).view(np.uint64):
        place = int(key) >> 40
        table[place >> 3] |= 1 << (place & 7)

    class Shared:
        value = (table, 24)

    sent = pa.Table.from_batches(list(phrases._counts(4, Shared)(iter([batch])))).to_pylist()
    assert {(r["lang"], r["phrase"]): r["f"] for r in sent} == {
        ("en", ""): 300, ("de", ""): 3, **{("en", p): 50 for p in ("ice", "cream", "van", "ice cream", "cream van", "ice cream van")}
    }


def test_bits_that_phrases_share_change_no_result(spark, monkeypatch):
    """Every bit is set, so that each phrase is counted by its text."""
    monkeypatch.setattr(phrases, "key_table", lambda keys: (np.full(1 << 12, 255, np.uint8), 15))
    rows = texts(14, 60)
    assert mined(spark, rows, min_count=4) == plain(rows, 4, 4, 2000)


def test_table_of_bits(spark):
    keys = [0, -1, 1, 1 << 62, -(1 << 63), 12345678901234567]
    table, bits = phrases.key_table(spark.createDataFrame([(k,) for k in keys], "key long"))
    known = phrases.Known(table, bits)
    assert known.holds(np.array(keys, dtype=np.int64).view(np.uint64)).all()
    assert int(np.unpackbits(table).sum()) == len({(k % (1 << 64)) >> (64 - bits) for k in keys})
