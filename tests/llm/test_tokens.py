"""The cached encoder against the tokenizers library alone, on every text of the fixture and odd ones."""

import duckdb
import pytest

import brute


@pytest.mark.parametrize(("name", "end"), [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)])
def test_same_ids(name, end):
    import public_tokenizers

    from lodestar.llm.tokens import Encoder

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
    odd = ["", " ", "  two  spaces ", "\ttab\n\nlines\r\n", "<|endoftext|> inside<|startoftext|>", "it's THEY'LL don’t", "漢字 かな 한글", "ÀÉÎ straße ſ", "1234567 3.14 a1b2", "a b  c", "\0null\0byte", "emoji 😀👍🏽", "x" * 5000, "—dash… “quotes”", None]
    rows += [(-1 - i, t) for i, t in enumerate(odd)]
    encoder = Encoder(public_tokenizers.path(name))
    got = encoder.ids([t or "" for _, t in rows])
    import numpy as np

    for (i, want), data in zip(brute.tokens(rows, name, end), got, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == want[:-1], i
