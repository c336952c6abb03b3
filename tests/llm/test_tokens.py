import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tierloom.llm.byte_bpe import byte_bpe
from tierloom.llm.packing import pack, pack_documents, step_groups

TEXTS = ["", None, " ", "don't  stop\n\n\tnow ", "Été 1²³ ſ", "\x1c\x85\xa0x", "日本語 テキスト 한국어", "a" * 5000, "İstanbul ΑΣ ß", "<|endoftext|> 'LL", "a <|endoftext|> b<|StartOfText|>c", "x <|startoftext|>y", "e\u0301 \U00018fcc렽", "🙂👩‍👩‍👧 x" * 40, "word " * 9000]


def docs(spark):
    r = random.Random(0)
    mixed = ["".join(chr(r.choice([32, 39, 10, r.randrange(32, 127), r.randrange(160, 384), r.randrange(0x2000)])) for _ in range(60)) for _ in range(150)]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS + mixed)] + [(3, TEXTS[3], 1, "x")], "doc_id long, text string, n_tokens int, start string").repartition(3)


def test_byte_bpe_is_tiktoken(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs(spark)
    text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    got = byte_bpe(df, path, P.PATTERN).collect()
    assert len(got) == len(text) + 1
    for r in got:
        ids = enc.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe(df.where("false"), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("ordinary", [False, True])
def test_packing_holds_each_id_once(spark, ordinary):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    if ordinary:
        tok.encode_special_tokens = True
    df = docs(spark).dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for r in df.collect()}
    got = (pack_documents(df, path, ordinary_specials=True) if ordinary else pack_documents(df, path)).collect()
    at, sequences = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : at[r["doc_id"]]].tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    assert at == {k: len(v) for k, v in ids.items()}
    for pieces in sequences.values():
        end = 0
        for offset, n, tier in sorted(pieces):
            assert offset == end
            end += n
        assert end == tier <= 2048 and end & (end - 1) == 0
    assert pack_documents(df.where("false"), path).count() == 0


def test_pack_and_step_groups():
    r = random.Random(1)
    for _ in range(100):
        lengths = [r.choice([r.randrange(1, 40), r.randrange(1, 3000), r.randrange(1, 10000)]) for _ in range(r.randrange(40))]
        out = pack(lengths)
        seen = sorted((d, s, n) for _, w in out for d, s, n in w)
        for d, total in enumerate(lengths):
            end = 0
            for _, s, n in (x for x in seen if x[0] == d):
                assert s == end
                end += n
            assert end == total
        assert all(sum(x[2] for x in w) == t for t, w in out)
    groups = step_groups([2048] * 40 + [1024] * 7 + [64] * 3, 1 << 14)
    load = np.bincount(groups, [2048] * 40 + [1024] * 7 + [64] * 3)
    assert load.max() - load.min() <= 2048
