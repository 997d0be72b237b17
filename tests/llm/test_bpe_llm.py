import hashlib
import random

import pytest

from ionweave.llm.bpe import Bpe, byte_chars, encode_column, round_trip
from ionweave.llm.caching import Memo


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=1500):
    rnd = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "'s", "'", "12", "ü", "\x1c", "\x85", "\xa0", "漢", "😀", "<|endoftext|>", "|", "###", "é", "​", "　", "\x00", " "]
    letters = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["", "a" * 5000, "ab" * 3000, *(letters(k) for k in (62, 63, 64, 65, 66, 67, 127, 128, 129, 130, 9000))]


def test_ids_and_texts_equal_the_library(path, library):
    bpe = Bpe(path, memo=500)
    some = texts()
    for text, ids in zip(some, bpe.encode_all(some), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_decoding_parts_of_characters(path, library):
    bpe = Bpe(path)
    ids = bpe.encode("漢字😀")
    for k in range(len(ids) + 1):
        assert bpe.decode(ids[:k]) == library.decode(ids[:k], skip_special_tokens=False)


def test_bytes_have_characters_of_their_own():
    assert len(set(byte_chars())) == 256


def test_memo_does_not_change_results():
    memo = Memo(lambda keys: [k * 2 for k in keys], limit=3)
    for keys in ({"a", "b"}, {"b", "c", "d"}, {"a"}, set("abcdefgh"), {"h"}):
        got = memo.ready(keys)
        assert {k: got[k] for k in keys} == {k: k * 2 for k in keys}


def test_round_trip_and_column(spark, library):
    rows = [(1, "Hello there", 3), (2, None, 4), (2, "", 5), (None, "x<|endoftext|>y", 6), (1, "Hello there", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = round_trip(df).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(got) == 5
    want = sorted((str(i), len(e := library.encode(t or "", add_special_tokens=False).ids), sha(",".join(map(str, e))), sha(t or "")) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert encode_column(df, out_col="ids").filter("text = 'Hello there'").first()["ids"] == library.encode("Hello there").ids
    assert round_trip(df.limit(0)).count() == 0
