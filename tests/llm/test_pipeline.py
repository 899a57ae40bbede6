import random
import zlib

import numpy as np
import public_tokenizers

from tests.llm.conftest import prose
from tests.llm.test_pairs_and_records import brute_join
from tests.llm.test_text_operators import brute_counts, brute_secrets

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All labels are clean, so mixing keeps each document once; too few for a cutoff, so only the base rules reject."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    dice, rows = random.Random(11), []
    for n in range(40):
        text = prose(dice, 90, 5000) + (f" password={'k1' * 8}" if n % 6 == 0 else "")
        rows += [text] if n % 3 else [text, text.replace(" ", "  "), text + " more"]
    rows += ["too short", None, "", "again and again " * 40]
    docs = [(n, t, "en", f"src{n % 3}", len(t or "")) for n, t in enumerate(rows)]
    spark.createDataFrame(docs, KINDS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, 1, 0) for n in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    good = [(n, t) for n, t, *_ in docs for c in [brute_counts(t)] if c[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    firsts = [(n, t) for n, t in good for _, first in [brute_join(good)[n]] if n == first]
    plain, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for n, t in firsts:
        for span in reversed([x for x in brute_secrets(t).split(",") if x]):
            kind, a, b = span.split(":")
            t = t[: int(a)] + f"[{kind}]" + t[int(b) :]
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want.append((n, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
