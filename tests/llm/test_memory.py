"""What a worker holds: batches are small, and a tokenizer file is read only where a text needs it."""

import public_tokenizers

from tessera import session
from tessera.llm import packing

FILES = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]


def test_tokenizer_file_is_read_for_rare_texts_only():
    packing.tokenizer.cache_clear()
    packing._from_file.cache_clear()
    of = packing.tokenizer(*FILES, public_tokenizers.PATTERN)
    assert of("plain words") and packing._from_file.cache_info().currsize == 0
    text = "写 ก words <|endoftext|>"
    assert of(text) == packing.Tokenizer.from_file(FILES[0]).encode(text, add_special_tokens=False).ids
    assert packing._from_file.cache_info().currsize == 1


def test_batches_are_bounded(spark):
    session.expose_package(spark)
    assert session.BATCH_BYTES <= 2 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(session.BATCH_BYTES)
