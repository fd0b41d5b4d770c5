"""Columns of the input whose names an operator uses itself change nothing, whatever they hold."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gatelight.llm import alignment, bpe, filter_audit, hash_ring, media, packing, quality, token_files, toxicity

TEXTS = [(1, "some plain words here"), (2, None), (3, ""), (4, "some plain words here"), (None, "other words"), (7, "very bad words $$$ " * 9)]
NAMES = {
    "bpe": "ids n_tokens tokens data decoded n key block part ids_sha256",
    "quality": "weight kept key score n_grams folded gram cell label sampled id toxic copies",
    "token_files": "ids n range_ path first bytes docs start n_tokens key before",
    "packing": "key n ids range_ start length sequence_id offset doc_tokens",
    "toxicity": "folded toxic copies pattern clean score predicted held_out id stem",
    "media": "data media payload n_bytes times codes feature",
    "hash_ring": "text_id size text_crc32 copies arc turn cell before first pieces piece low high at shard slot rows most",
    "filter_audit": "word text_id first_id n_words n_distinct A B C D E part good toxic c own before all step filter_order",
    "alignment": "block pairs docs pair nr totals n_a n_b groups link_n n_docs best highest",
}


def runs(docs, labels):
    rule = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    return {
        "bpe": lambda: bpe.digests(bpe.decode_table(bpe.encode_table(docs, *rule), *rule)),
        "quality": lambda: quality.resample(docs, labels),
        "token_files": lambda: token_files.digests(token_files.read(token_files.write(docs, P.path("byte_bpe_50k.json")))),
        "packing": lambda: packing.digests(packing.pack(docs, P.path("word_bpe_49k.json"))),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels)),
        "media": lambda: media.digests(media.fingerprints(media.to_wav(docs))),
        "hash_ring": lambda: hash_ring.digests(hash_ring.place(docs, 2)),
        "filter_audit": lambda: filter_audit.interactions(filter_audit.failures(docs), labels),
        "alignment": lambda: alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))[0],
    }


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names(spark, name):
    plain = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    odd = plain.select(*[F.lit("odd").alias(c) for c in NAMES[name].split()], "*")
    own, other = (sorted(map(str, runs(docs, labels)[name]().collect())) for docs in (plain, odd))
    assert own == other and own
