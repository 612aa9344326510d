import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cinderlake.llm import packing
from cinderlake.llm._words import Words, buffers

from .helpers import awkward, frame

SF = "/root/testdata/sf0.01"


def check(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for d, t in texts:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for s in held.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r.length for r in rows)


@pytest.mark.parametrize("source", ["awkward", "sf"])
def test_pieces_and_sequences(spark, source):
    docs = frame(spark, awkward()) if source == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    used, tokens = check(packing.pack(docs).collect(), texts)
    if source == "sf":
        assert used <= -(-tokens // 2048) * 1.005


def encoded(e, texts):
    ids, at = e.encode(Words(*buffers(pa.array(texts, pa.string()))))
    return [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)]


def test_odd_words_go_the_tokenizers_way():
    e = packing.Encoder(packing.default_tokenizer())
    texts = ["It's DON'T we'LL <|endoftext|> x<|startoftext|>y", "İstanbul éa ǅ ²½   a b\u0085c \x1c z", "中文 \U0001f600‍ሴ naïve Ñandú", "$$$!!! 3,14 a_b--c", "", "  ", "a\x00b \x01"]
    assert encoded(e, texts) == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


@pytest.mark.parametrize("size", [1, 20, 50, 90])
def test_memory_may_overflow(size):
    e = packing.Encoder(packing.default_tokenizer(), size)
    for k in range(20):
        texts = [" ".join(f"w{random.Random(k * 7 + i).randrange(60)}" for i in range(30)) for _ in range(2)]
        assert encoded(e, texts) == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert len(e.hash) <= max(size, 31)


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_the_histogram(seed):
    r = random.Random(seed)
    top = (2048, 100, 2048, 700, 2048, 1300)[seed]
    h = Counter(r.randint(1, top) for _ in range((0, 500, 4000, 3000, 1, 3000)[seed]))
    h[2048] += 3 * (seed == 2)
    made, c = packing.plan(h), Counter()
    for held, n in made:
        assert sum(held) <= 2048 and n > 0
        for x in held:
            c[x] += n
    assert c == +h
    used, least = sum(n for _, n in made), -(-sum(x * n for x, n in h.items()) // 2048)
    assert used <= least * 1.01 + 1


def test_empty(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_a_new_table_of_words_makes_others_let_go():
    from cinderlake.llm import _words

    held = [1]
    _words.keeps(held.clear)
    packing._known.clear()
    packing.encoder(packing.default_tokenizer())
    packing._known.clear()
    assert held == []
