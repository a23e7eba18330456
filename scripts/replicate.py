"""Write a k-fold replica of the driver tables into a scratch folder for scale
document / vector gets k-1 exact copies; the other tables are linked.

usage: python scripts/replicate.py SRC_DIR DST_DIR [k]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from evalpack.session import local_session  # noqa: E402
from evalpack.sources.tables import TABLES  # noqa: E402


def main(src: str, dst: str, k: int) -> None:
    spark = local_session(8)
    os.makedirs(dst, exist_ok=True)
    docs = spark.read.parquet(f"{src}/documents.parquet")
    n = docs.agg(F.max("doc_id")).first()[0] + 1
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("copy")
    (docs.select("*", copy).withColumn("doc_id", F.col("doc_id") + F.col("copy") * n)
     .drop("copy").repartition(8).write.mode("overwrite").parquet(f"{dst}/documents.parquet"))
    emb = spark.read.parquet(f"{src}/embeddings.parquet")
    m = emb.agg(F.max("vec_id")).first()[0] + 1
    (emb.select("*", copy).withColumn("vec_id", F.col("vec_id") + F.col("copy") * m)
     .drop("copy").repartition(8).write.mode("overwrite").parquet(f"{dst}/embeddings.parquet"))
    for t in TABLES:
        if t not in ("documents", "embeddings") and not os.path.exists(f"{dst}/{t}.parquet"):
            os.symlink(f"{src}/{t}.parquet", f"{dst}/{t}.parquet")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else 10)
