"""Operator 9: byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from tieline.llm.common import doc_texts, per_row
from tieline.llm.subwords import rank_file_encoder


def encode_documents(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids, decoded): token ids of each text and the bytes they decode to.

    Null and empty texts have no ids.  Repeated rows stay repeated.  Work is per row; nothing is shuffled.
    """

    def start():
        bpe = rank_file_encoder(rank_file)

        def work(doc_ids, texts):
            ids = [bpe.encode(t) for t in texts]
            return [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.binary())]

        return work

    return per_row(doc_texts(docs), start, "doc_id bigint, ids array<int>, decoded binary", ["doc_id", "ids", "decoded"])


def encoding_digests(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), digested where the ids are made."""

    def start():
        bpe = rank_file_encoder(rank_file)
        digits = {i: str(i) for i in bpe.ids}

        def work(doc_ids, texts):
            n, a, b = [], [], []
            for t in texts:
                ids = bpe.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return work

    return per_row(doc_texts(docs), start, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
