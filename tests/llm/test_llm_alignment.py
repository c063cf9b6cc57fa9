from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from helpers import ODD, documents
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from venuesift.llm import alignment

TEXTS = [
    (1, "The cat sat on the mat, twice."), (2, "naïve café \U0001d11e ｆｕｌｌ"), (3, " leading and  double  blanks \n\n\ttabs"),
    (4, "x▁y"), (5, "<|endoftext|> and <s> <unk> </s> <0x41>"), (6, "12345 67890 !!! ??? ..."), (7, "The cat sat on the mat, twice."),
    (8, "a\0b"), (9, "Ⅳ ﬁ é"),
]


def plain(rows):
    """Offsets in sets, links by comparing all ranges of a group, counts in dictionaries."""
    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    file.encode_special_tokens = True
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    decoder = ByteLevel()

    def a_bytes(i):
        signs = {c: b for b, c in _byte_signs().items()}
        return bytes(signs[c] for c in file.id_to_token(i))

    def b_bytes(i):
        return bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    assert decoder.decode(["Ġa"]) == " a"
    found = []
    for doc_id, text in rows:
        a = file.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != data or b"".join(map(b_bytes, b)) != data:
            a, b = [], []
        ranges = []
        for ids, of in ((a, a_bytes), (b, b_bytes)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + len(of(i))))
                at = spans[-1][1]
            ranges.append(spans)
        common = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, start = [], 0
        for end in common:
            groups.append("|".join(
                ",".join(str(i) for i, (s, e) in zip(ids, spans, strict=True) if start <= s and e <= end)
                for ids, spans in zip((a, b), ranges, strict=True)
            ))
            start = end
        links = [
            (a[i], b[j]) for i, (s, e) in enumerate(ranges[0]) for j, (t, f) in enumerate(ranges[1]) if s < f and t < e
        ]
        found.append((doc_id, a, b, groups, links))
    count = Counter(link for *_, links in found for link in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted((
        (doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
         sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc_id, a, b, groups, links in found
    ), key=str)


def _byte_signs():
    """The characters of byte-level entries, byte by byte."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(others)}


def linked(spark, rows, **options):
    return sorted(map(tuple, alignment.linked_documents(documents(spark, rows), **options).collect()), key=str)


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 300])
def test_equals_the_plain_version(spark, block_bytes):
    chance = random.Random(4)
    words = [w for _, text in TEXTS for w in text.split(" ")] + ["über", "tokenization", "中文", "thingbly"]
    rows = TEXTS + [(i, " ".join(chance.choice(words) for _ in range(chance.randint(0, 60)))) for i in range(20, 60)]
    assert linked(spark, rows, block_bytes=block_bytes) == plain(rows)


def test_odd_rows(spark):
    rows = [row for row in ODD if len(row[1] or "") < 1000] + [(4, "long " * 900 + "end")]
    assert linked(spark, rows) == plain(rows)
    assert linked(spark, []) == []
    assert linked(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignments_hold_ids_and_cuts(spark):
    row = alignment.alignments(documents(spark, [(1, "hello world")])).first()
    a, b = alignment.byte_level(), alignment.sentence_pieces()
    assert b"".join(a.tokens[i] for i in row["a_ids"]) == b"".join(b.tokens[i] for i in row["b_ids"]) == b" hello world"
    assert row["a_cuts"][-1] == len(row["a_ids"]) and row["b_cuts"][-1] == len(row["b_ids"])
    assert len(row["a_links"]) == len(row["a_ids"]) + len(row["b_ids"]) - len(row["a_cuts"])


def test_a_text_of_half_a_million_characters():
    text = "".join(random.Random(1).choice("ab c\n") for _ in range(500_000))
    found = alignment.align(text, alignment.byte_level(), alignment.sentence_pieces())
    assert found.a_cuts[-1] == len(found.a) and found.b_cuts[-1] == len(found.b)
    assert len(alignment.group_text(found).split(b";")) == len(found.a_cuts)


def test_tokens_that_do_not_spell_the_text_give_nothing():
    wrong = alignment.Tokenizer(lambda text: [0], [b" z"])
    assert alignment.align("abc", wrong, alignment.sentence_pieces()) is alignment.NOTHING
