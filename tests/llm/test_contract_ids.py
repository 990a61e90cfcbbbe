"""The query of op12 ends documents with id 0, as its contract says, whatever the operator's default."""

import zlib

import numpy as np

from gridrisk.llm import queries


def test_op12_ends_documents_with_id_0(spark, odd, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for x in odd.collect():
        ids = [*library.encode(x.text or "", add_special_tokens=False).ids, 0]
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(x.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in queries.op12_histogram_packing(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
