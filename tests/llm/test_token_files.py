import random
import zlib

import numpy as np
import pytest
from odd_rows import ODD

from docspark.llm import token_files
from docspark.llm.queries import tokenizer_path
from docspark.llm.token_files import Encoder, TokenFile, read_token_files, write_token_files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_the_library(tokenizer):
    random.seed(1)
    signs = [" ", "  ", "\n", "\t", " \n", "\n ", "a", "bc", "'s", "12", "é", "ñ", "\x1c", "\x85", "\xa0", "<|endoftext|>", "!", "??", "   ", "日本", "\U0001f600", "ß"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 14))) for _ in range(5000)] + ["", " ", "x" * 500]
    found = Encoder(tokenizer_path(), "<u2").encode(texts)
    assert found == [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def library(tokenizer, texts):
    return [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_chunks_cut_into_pieces_equal_the_library(tokenizer):
    random.seed(2)
    parts = ["on", "Heha", "é", "Éa", "ǅ", "ÿ", "12", "٣", "½", ".", ",", "***", "!?", "'", "'s", "'LL", "\\", "]", "_", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u0301", "Ġ", "Ċ", "日", "x" * 50]
    texts = [" ".join("".join(random.choices(parts, k=random.randint(0, 5))) for _ in range(random.randint(1, 8))) for _ in range(6000)]
    encoder = Encoder(tokenizer_path(), "<u2")
    assert [x for k in range(0, 6000, 500) for x in encoder.encode(texts[k : k + 500])] == library(tokenizer, texts)
    assert encoder.encode([]) == [] and encoder.encode(["", "a  ", " "]) == library(tokenizer, ["", "a  ", " "])


def test_a_sign_alone_after_an_empty_chunk(tokenizer):
    encoder = Encoder(tokenizer_path(), "<u2")
    for texts in (["a  b"], ["a , b"], ["a \nb"], ["é , é, é"], ["12, 12"]):
        assert encoder.encode(texts) == library(tokenizer, texts)


def test_only_odd_chunks_go_through_the_splitter(monkeypatch):
    encoder = Encoder(tokenizer_path(), "<u2")
    sent = []
    monkeypatch.setattr(encoder, "ids", lambda texts, ids=encoder.ids: sent.extend(texts) or ids(texts))
    encoder.encode(["A line.\nThe next, of 12 (or 13) marked*** words: d'un mot 日本", "A line.\nThe next, d'un mot"])
    assert sorted(sent) == [" d'un", " 日本", "A", "A"]


def test_a_full_memory_forgets_what_was_not_met_again(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 200)
    encoder = Encoder(tokenizer_path(), "<u2")
    most = 0
    for k in range(40):
        texts = [" the same, " + " ".join(f"{a}{b}" for a in "abcde" for b in "vwxyz") + f" w{'abcdefghij'[k % 10] * (1 + k // 10)}" + "".join(f" q{x}{k}'" for x in "rstuvwxyz")]
        assert encoder.encode(texts) == library(tokenizer, texts)
        assert "same" in encoder.known
        most = max(most, len(encoder.known) + len(encoder.older))
    assert most <= 2 * 200


def expected(rows, tokenizer):
    out, start = [], 0
    for d, t in sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("rows", [ODD, [(i * 7 % 90, f"text {i} " + "word, " * (i % 50), "s") for i in range(300)]])
def test_round_trip(spark, documents, tokenizer, tmp_path, rows):
    manifest = write_token_files(documents(rows).repartition(5), tokenizer_path(), f"{tmp_path}/files", length=32, batch=4)
    got = read_token_files(manifest).drop("part").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows, tokenizer)
    ids, masked = [], []
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        file = TokenFile(row.path)
        total = 0
        for k in range(file.sequences.num_record_batches):
            for i in range(len(file.sequences.get_batch(k))):
                values, mask = file.sequence(k * file.batch + i)
                assert len(values) == len(mask) == 32 and not values.flags.owndata
                masked += mask.to_pylist()
                ids += values[np.array(mask.to_pylist())].tolist()
                total += sum(mask.to_pylist())
        assert total == row.n_tokens
    assert len(ids) == sum(r[2] for r in expected(rows, tokenizer))


def test_empty_table(documents, tmp_path):
    manifest = write_token_files(documents([]), tokenizer_path(), f"{tmp_path}/none")
    assert manifest.count() == 0 and read_token_files(manifest).count() == 0
