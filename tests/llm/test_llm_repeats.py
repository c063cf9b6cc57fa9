from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents

from venuesift.llm import repeats


def brute(rows, length):
    """Every window of every text in one dictionary."""
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    seen = Counter(data[i:i + length] for _, data in texts for i in range(len(data) - length + 1))
    out = []
    for doc_id, data in texts:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen[data[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, away in zip(data, gone, strict=True) if not away)
        spans = sum(1 for i, away in enumerate(gone) if away and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(spark, rows, length):
    found = repeats.remove_repeats(documents(spark, rows), length=length)
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4]), r[5]) for r in found.collect()), key=str)


def shared_passages(seed):
    """Texts with passages in common, cut anywhere, and other words around them."""
    chance = random.Random(seed)
    words = ["".join(chance.choice("abcdé") for _ in range(chance.randint(1, 6))) for _ in range(60)]

    def prose(n):
        return " ".join(chance.choice(words) for _ in range(n))

    passages, rows = [prose(chance.randint(20, 160)) for _ in range(5)], []
    for i in range(70):
        parts = [prose(chance.randint(0, 90))]
        for _ in range(chance.randint(0, 3)):
            passage = chance.choice(passages)
            at = chance.randint(0, len(passage) // 2)
            parts += [passage[at:at + chance.randint(50, 700)], prose(chance.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("length", [200, 61])
def test_equals_brute_force(spark, length):
    rows = shared_passages(length)
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, "x" * 999), (300, None), (302, "ab" * 300), (303, "é" * 250)]
    assert removed(spark, rows, length) == brute(rows, length)


def test_odd_rows(spark):
    rows = [row for row in ODD if len(row[1] or "") < 1000] + [(4, "long " * 2000 + "end")]
    assert removed(spark, rows, 200) == brute(rows, 200)
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_one_passage_in_half_of_the_texts(spark):
    """Everything around the passage differs, so its ends tie in very many ways."""
    chance = random.Random(3)

    def noise():
        return "".join(chance.choice("abcdefghij ") for _ in range(150))

    passage = "".join(chance.choice("klmnop ") for _ in range(260))
    rows = [(i, noise() + passage + noise() if i % 2 else noise()) for i in range(400)]
    assert removed(spark, rows, 200) == brute(rows, 200)


def test_blocks_of_a_long_text_meet(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 64)
    rows = shared_passages(5)[:20]
    data = rows[0][1].encode()
    assert [at for at, _ in repeats._blocks(data, 200)] == list(range(0, len(data) - 199, 64))
    anchors = Counter()
    for _, text in rows:
        for _, part in repeats._blocks(text.encode(), 200):
            anchors.update(repeats.chosen_hashes(part, 200).tolist())
    seen = Counter(text.encode()[i:i + 200] for _, text in rows for i in range(len(text.encode()) - 199))
    for _, text in rows:
        for start, part in repeats._blocks(text.encode(), 200):
            for i, least in enumerate(repeats.least_hashes(part, 200).tolist()):
                if anchors[least] == 1:  # what the anchors rule out does not repeat
                    assert seen[text.encode()[start + i:start + i + 200]] == 1


@pytest.mark.parametrize("period", [1, 2, 3, 7, 10, 30, 73, 100])
def test_every_difference_is_covered(period):
    cover = repeats.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert all(0 <= a < period for a in cover)


def test_least_hashes_equal_plain_minima():
    chance = random.Random(9)
    data = np.frombuffer(bytes(chance.choice(b"ab") for _ in range(700)), dtype=np.uint8)
    gram, width = repeats._gram(60), 60 - repeats._gram(60) + 1
    hashes = repeats.gram_hashes(data, gram).tolist()
    strings = [data[i:i + gram].tobytes() for i in range(len(hashes))]
    assert len(set(zip(strings, hashes, strict=True))) == len(set(strings)) == len(set(hashes))
    plain = [min(hashes[i:i + width]) for i in range(len(hashes) - width + 1)]
    least, chosen = repeats.least_hashes(data, 60), repeats.chosen_hashes(data, 60)
    assert least.tolist() == plain and set(chosen.tolist()) == set(plain)


def test_names_tell_substrings_and_salts_apart():
    piece = b"abcabcabd" * 40
    names = repeats.Names(piece)
    firsts = np.repeat(np.arange(300), 3)
    ends = firsts + np.tile([5, 20, 41], 300)
    found = list(zip(*(part.tolist() for part in names.of(firsts, ends)), strict=True))
    strings = [piece[a:b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
    assert len(set(zip(found, strings, strict=True))) == len(set(found)) == len(set(strings))
    assert not set(zip(*(part.tolist() for part in names.of(firsts, ends, 1)), strict=True)) & set(found)


def test_equal_ranks_of_different_bytes_only_add_windows_to_compare(spark):
    """A rank is 64 bits; what repeats is told by the 128 bits of the windows."""
    rows = [(1, 1, 1, 10), (1, 1, 1, 11), (1, 2, 2, 12), (2, 3, 3, 13)]
    samples = spark.createDataFrame(
        [(*row, 0, 5, 9) for row in rows], "rank long, w1 long, w2 long, text_id long, start long, low long, high long"
    )
    judged = {r["text_id"]: (r["ties"], r["speaks"]) for r in repeats.judged_samples(samples).collect()}
    assert sorted(judged) == [10, 11, 12] and judged[12] == (False, True)
    assert sorted([judged[10], judged[11]]) == [(True, False), (True, True)]


@pytest.mark.parametrize(("length", "period"), [(200, 73), (61, 30), (2, 1)])
def test_cover_samples_are_all_places_of_the_cover(length, period):
    for size in (length, length + 1, 5 * period + length, 1000):
        places, low, high = repeats.cover_samples(b"x" * size, length, period)
        last = size - length
        assert places.tolist() == [p for p in range(last + period) if p % period in repeats.difference_cover(period)]
        assert low.tolist() == [max(p - period + 1, 0) for p in places] and high.tolist() == [min(p, last) for p in places]
