"""Texts that spell the end mark count as many tokens as the tokenizer gives them."""

import public_tokenizers
from tokenizers import Tokenizer

from trackgeo.llm import token_scan
from trackgeo.session import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_spelt_end_marks_are_counted(spark):
    tokenizer = Tokenizer.from_file(PATH)
    assert tokenizer.get_vocab_size() <= token_scan.SPELT
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "plain", ""]
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    path = new_path(spark)
    token_scan.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, PATH)
    assert {r.doc_id: r.n_tokens for r in token_scan.scan_token_files(spark, path).collect()} == want
    assert want[1] == 1
