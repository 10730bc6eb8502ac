import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from quillspark.llm import align, queries

EMPTY = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def spell():
    """Tokens with their bytes by the two libraries named in the contract."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}

    def of(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        one = [(i, bytes(shown[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>") for i in ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return one, two

    return of


def brute(rows, spell):
    """(id, measures) by the contract's words: every pair of tokens is compared."""
    seen, pairs = {}, Counter()
    for _, text in rows:
        if text and text not in seen:
            one, two = spell(text)
            want = (" " + text).encode()
            ok = b"".join(x for _, x in one) == want == b"".join(x for _, x in two)
            ranges = []
            for side in (one, two):
                at, out = 0, []
                for i, x in side:
                    out.append((at, at + len(x), i))
                    at += len(x)
                ranges.append(out)
            seen[text] = ranges if ok else None
    links = {}
    for text, r in seen.items():
        links[text] = [(a[2], b[2]) for a in r[0] for b in r[1] if a[0] < b[1] and b[0] < a[1]] if r else None
    for _, text in rows:
        if text and links[text]:
            pairs.update(links[text])
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    for i, text in rows:
        if not text or not seen[text]:
            yield (i, *EMPTY)
            continue
        one, two = seen[text]
        ends = sorted({y for _, y, _ in one} & {y for _, y, _ in two})
        shown, last = [], 0
        for e in ends:
            shown.append("|".join(",".join(str(k) for x, y, k in side if x >= last and y <= e) for side in (one, two)))
            last = e
        own = links[text]
        yield (i, len(one), len(two), len(ends), len(own), sum(pairs[p] == best[p[1]] for p in own), sum(pairs[p] for p in own), hashlib.sha256(";".join(shown).encode()).hexdigest())


TEXTS = [
    "Hello world", "  two  spaces\n\nand\ttabs ", "naïve café 漢字 😀 é", "▁ is not a space", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00\x01 zero", "a", " ", "\n", "1234567890 3.14159",
    "Straße übergroß", "don't can't I'll", None, "", "Hello world", "Hello world", "x" * 700, "word " * 120, "﻿bom", "ﬁ ligature ㎏ ½", "עברית العربية हिन्दी",
]


def run(df, **k):
    return sorted((tuple(r) for r in align.alignment(df, **k).collect()), key=str)


@pytest.mark.parametrize("block_bytes,hot", [(6 << 20, 1000), (60, 1)])
def test_equals_comparing_every_pair(spark, docs, spell, block_bytes, hot):
    rows = list(enumerate(TEXTS)) + [(100 + i, r.text[:900]) for i, r in enumerate(docs.select("text").limit(40).collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, block_bytes=block_bytes, hot=hot) == sorted(brute(rows, spell), key=str)


def test_copies_weigh_as_often_as_they_occur(spark, spell):
    """Of two A ids over one B id, the one in the more frequent text is the best, though both texts are aligned once."""
    rows = [(i, "unhappiness" if i % 3 else "unhappy happiness") for i in range(60)] + [(None, "unhappiness"), (3, "unhappiness")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = run(df, hot=10)
    assert got == sorted(brute(rows, spell), key=str) == run(df, hot=10**6)


def test_texts_that_are_not_spelled_are_zeros_however_many(spark, spell):
    rows = [(i, "▁ again") for i in range(50)] + [(99, "fine")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), hot=5) == sorted(brute(rows, spell), key=str)


def test_odd_rows(spark, odd, empty, spell):
    assert align.alignment(empty).count() == 0
    short = odd.selectExpr("doc_id", "left(text, 400) as text", "h", "t as digest", "block as unit", "n_chars as copies")
    assert run(short) == sorted(brute([(r.doc_id, r.text) for r in short.collect()], spell), key=str)
    assert align.alignment(odd).count() == odd.count()


def test_levels_of_buckets(spark, docs, monkeypatch):
    """Many buckets in two levels give what a few give."""
    some = docs.where("doc_id < 40")
    few = run(some)
    monkeypatch.setattr(align, "bits_for", lambda n: 11)
    assert run(some, block_bytes=20_000) == few


def test_query(spark):
    got = queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links <= max(1, r.count_sum) for r in got)
