"""python -m cubeweave.cli compress|decompress: archives of float32 files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from cubeweave.plans.compressor import archive_bytes, compress, decompress, load_header, verify
from cubeweave.sources.files import append_metrics
from cubeweave.sources.raw import read_raw, write_raw


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    c = sub.add_parser("compress")
    c.add_argument("--shape", required=True, help="sizes, as 20,256,256")
    c.add_argument("--error-bound", type=float, default=1e-3)
    c.add_argument("--n-frame", type=int, default=8)
    c.add_argument("--block", type=int, default=256)
    c.add_argument("--predictor", default="coarse4")
    c.add_argument("--codec", choices=("pca", "lorenzo"), default="pca")
    d = sub.add_parser("decompress")
    d.add_argument("--verify", help="the original file to compare with")
    d.add_argument("--metrics", help="folder of CSV metrics to append to")
    for s in (c, d):
        s.add_argument("source")
        s.add_argument("target")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("cubeweave").getOrCreate()
    if a.what == "compress":
        shape = [int(n) for n in a.shape.split(",")]
        compress(read_raw(spark, a.source, shape), shape, a.target, eps=a.error_bound, n_frame=a.n_frame, block=(a.block, a.block), predictor=a.predictor, codec=a.codec)
        print(json.dumps(archive_bytes(spark, a.target).first().asDict()))
        return 0
    frames = decompress(spark, a.source)
    write_raw(frames, a.target)
    if a.verify:
        head = load_header(a.source)
        found = verify(read_raw(spark, a.verify, head.shape), frames).first().asDict() | archive_bytes(spark, a.source).first().asDict()
        print(json.dumps(found))
        if a.metrics:
            append_metrics(spark, a.metrics, [found])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
