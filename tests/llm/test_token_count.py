"""Token counts against the library."""

import random

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
PIECES = [*"abcXYZ ' '<|>.,!0123\n\t", "é", "ß", "İ", "Σ", "ς", "é", " ", "　", "中", "文", "ﬁ", "😀", "‍", "̸", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'re", "١", "²", "K", "ก", "\x00", "\x1c", "\x85"]


def library(name, texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_of_random_texts(name):
    from wattlake.llm.token_count import TokenCounter

    rng, own = random.Random(1), TokenCounter(P.path(name))
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(4000)]
    got = [n for i in range(0, len(texts), 40) for n in own.counts(pa.array(texts[i : i + 40])).tolist()]
    assert got == library(name, texts)


def test_merges_take_the_lowest_rank_and_the_leftmost():
    from wattlake.llm.token_count import merge_count

    # 0 1 2 are letters; (1, 2) -> 3 comes first, then (0, 3) -> 4, then (0, 0) -> 5.
    ranks, made = {1 << 4 | 2: 0, 0 << 4 | 3: 1, 0 << 4 | 0: 2}, [3, 4, 5]
    count = lambda *s: merge_count(list(s), ranks, made, 4)
    assert (count(), count(0), count(0, 1, 2), count(0, 0, 1, 2), count(0, 0, 0), count(2, 1)) == (0, 0, 2, 2, 1, 0)


def test_whole_table(spark):
    from wattlake.llm.token_count import count_tokens

    long = "supercalifragilistic" * 20_000
    texts = [None, "", "  \n", "Hello, world!", "Hello, world!", long, "a " * 100_000, "x <|endoftext|> y", "word " * 2048, "word " * 2049]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS n_bytes")
    got = sorted(map(tuple, count_tokens(df, P.path("word_bpe_49k.json")).collect()), key=str)
    want = library("word_bpe_49k.json", [t or "" for t in texts])
    assert got == sorted([(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, want, strict=True)], key=str)
    assert count_tokens(df.where("false"), P.path("word_bpe_49k.json")).collect() == []


def test_other_vocabularies_are_refused(tmp_path):
    from wattlake.llm.token_count import TokenCounter

    path = tmp_path / "x.json"
    path.write_text('{"model": {"type": "WordPiece"}, "added_tokens": []}')
    with pytest.raises(ValueError):
        TokenCounter(str(path))
