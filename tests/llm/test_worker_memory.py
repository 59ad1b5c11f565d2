"""What a Python worker holds at a time: of a batch's results, and of words that it has met."""

import pyarrow as pa
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from vecloom.llm import byte_bpe
from vecloom.llm.common import STEP, with_computed


def test_results_of_a_batch_are_handed_on_as_they_come(spark):
    def make():
        def kernel(ids):
            own = pa.array([b"x" * 4_000] * len(ids), pa.binary())
            return [own, pa.array([pa.total_allocated_bytes()] * len(ids), pa.int64())]

        return kernel

    rows = 8 * STEP + 5
    found = with_computed(spark.range(rows).coalesce(1), ["id"], "own binary, held long", make)
    row = found.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.length("own")).alias("bytes"), F.max("held").alias("held")).first()
    assert (row.n, row.ids, row.bytes) == (rows, rows, rows * 4_000)
    assert row.held < 4 * STEP * 4_000  # of nine steps


def test_words_that_a_worker_remembers_are_bounded_and_change_no_ids():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    chunks, most = byte_bpe.Chunks(ranks, P.PATTERN), 0
    for top in range(0, 400_000, 10_000):
        text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17_576 % 26)}." for i in range(top, top + 10_000))
        ids = byte_bpe.encode_text(text, chunks)
        most = max(most, len(chunks) + len(chunks.words))
        if top % 100_000 == 90_000:
            assert ids == byte_bpe.packed(lib.encode_ordinary(text))
    assert most <= 310_000
