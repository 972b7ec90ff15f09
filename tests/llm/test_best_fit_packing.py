import zlib
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import best_fit_packing as B
from quern.llm.queries import tokenizer_path
from tests.llm.helpers import DOCS, awkward_texts, documents, with_clashes


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


HARD = ["It's I'll WE'RE 12³ ½x\x85a\xa0b İstanbul ǅ ß ŉ", "<|endoftext|> a", "ΣΑΣ日本", "don't'sa 'd'd", "a\x1cb", "#$%&**é'é_-", "", "ⅷ ١٢", "\x00\x7f\xad", "é ﬁ"]


def test_ids_equal_the_library_s(tokenizer):
    words = B.WordIds(tokenizer_path())
    for text in [*HARD, *(t or "" for t in awkward_texts())]:
        assert np.frombuffer(words.of_text(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("added_tokens", [False, True])
def test_ids_of_each_letter_beside_others_equal_an_untouched_tokenizer_s(tokenizer, added_tokens):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path()) if added_tokens else tokenizer
    words = B.WordIds(tokenizer_path(), added_tokens)
    lowered = [c for c in range(0x2B0, 0x30000) if not 0xD800 <= c < 0xE000 and all(ord(x) < 0x250 for x in chr(c).lower())]
    for c in [*range(0x2B0), *lowered]:
        for text in ("{}", "a{}", "{}a", "1{}", "{}1", "'{}", "{}'", "Z{}Z", "{0}{0}", "'s{}s'S"):
            text = f"so {text.format(chr(c))} on"
            assert np.frombuffer(words.of_text(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, (hex(c), text)
    assert np.frombuffer(words.of_text("Ɔkyeame"), "<u4").tolist() == [133, 242, 74, 693, 780]


def check_packing(rows, texts, tokenizer, length):
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, B.END_ID]
        pieces = sorted(whole[i], key=lambda r: r.piece)
        assert [(p.piece, p.start) for p in pieces] == [(k, k * length) for k in range(-(-len(ids) // length))]
        for p in pieces:
            part = ids[p.start : p.start + length]
            assert (p.length, p.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), sum(r.length for r in rows)


@pytest.mark.parametrize("group", [B.GROUP, 9])
def test_every_token_is_placed_once(spark, tokenizer, group):
    texts = [*awkward_texts(), *HARD]
    got = B.packed_sequences(with_clashes(documents(spark, texts)), tokenizer_path(), length=256, group=group).collect()
    n, tokens = check_packing(got, texts, tokenizer, 256)
    assert n <= 1.08 * tokens / 256 + 1


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 20, 300)
    bins, offsets = B.sum_of_squares(sizes, 20)
    levels: dict[int, int] = {}
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def squares(change):
            counts = defaultdict(int)
            for level in ({**levels, **change}).values():
                counts[level] += level < 20
            return sum(n * n for n in counts.values())

        choices = [squares({-1: s})] + [squares({k: v + s}) for k, v in levels.items() if v + s <= 20]
        assert o == levels.get(b, 0)
        levels[b] = o + s
        assert squares({}) == min(choices)
    assert max(levels.values()) <= 20


def test_empty_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)], DOCS)
    got = B.packed_sequences(docs, tokenizer_path()).collect()
    assert [(r.length, r.sequence_id == got[0].sequence_id) for r in got] == [(1, True)] * 3
    assert sorted(r.offset for r in got) == [0, 1, 2]
    assert B.packed_sequences(docs.limit(0), tokenizer_path()).count() == 0


def test_the_query_and_the_pipeline_encode_like_an_unmodified_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quern.llm.queries import op4_best_fit_packing

    plain = Tokenizer.from_file(tokenizer_path())
    assert plain.encode("<|startoftext|>", add_special_tokens=False).ids == [49406]
    texts = [*HARD, "Hi <|startoftext|> a<|ENDOFTEXT|>b <|endoftext|>", "a<|endoftext|>b's <|startoftext|><|endoftext|>", "<|startoftext|>日本", "<|endoftext |>"]
    words = B.WordIds(tokenizer_path(), added_tokens=True)
    for text in [*texts, *(t or "" for t in awkward_texts())]:
        assert np.frombuffer(words.of_text(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    docs = documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for got in (op4_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.sequences(spark, docs, str(tmp_path))):
        check_packing(got.collect(), texts, plain, B.LENGTH)
