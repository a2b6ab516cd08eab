"""Packing of texts with runs that the fast encoder gives up on."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 1_000_000, "a" * 3_000_000, "x" + "\t" * 1_000_000 + " y", "é \n" * 400_000])
def test_long_runs_have_the_tokenizers_ids(text):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encode(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_long_runs_are_packed(spark):
    rows = [(1, " " * 1_000_000), (2, "a b c"), (3, "\n" * 1_000_000)]
    pieces = packing.packed_pieces(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = {1: 0, 2: 0, 3: 0}
    for r in pieces:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {i: len(packing.encode(t)) for i, t in rows}
