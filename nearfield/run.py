"""The program: repeated searches of a matrix with random queries, each held against the exact one, and a log of them.

``python -m nearfield.run -m matrix.mtx -t 30 -k 100`` runs one setting; :func:`sweep` runs all combinations of some.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from .functions.params import Params, parse
from .index import SimilarityIndex
from .operators import generate, matrix
from .sources.result_logs import COLUMNS, write_log

SCHEMA = ", ".join(f"{c} " + ("array<long>" if c.endswith("_idx") and "res" in c else "array<double>" if c.endswith("_val") and "res" in c else "double" if c.endswith("_ms") else "long") for c in COLUMNS["fpga"])


def run(spark: SparkSession, params: Params) -> DataFrame:
    """A row for each iteration, with the columns of an accelerator's log: how many of the results differ from the
    exact ones in row and in value, the times of both searches in milliseconds, and both lists."""
    if params.blocks:
        spark.conf.set("spark.sql.shuffle.partitions", params.blocks)
    index = SimilarityIndex.load(spark, params)
    cols = (matrix.num_rows(index.coo.selectExpr("col AS row")) or 1) if params.matrix else 1024
    rows = []
    for i in range(params.iterations):
        if i == 0 or params.reset:
            index.reset(generate.query_vector(spark, cols, seed=i + 1))
        began = time.perf_counter()
        exact = [(r["row"], float(r["score"])) for r in index.search(index.query, mode="nonnegative").collect()]
        took = 1000 * (time.perf_counter() - began)
        index.run()
        got = index.read_result()
        wrong = len({r for r, _ in exact} - {r for r, _ in got})
        off = sum(abs(a - b) > 1e-6 for (_, a), (_, b) in zip(exact, got, strict=False)) + abs(len(exact) - len(got))
        ms = {k: 1000 * v for k, v in index.times.items()}
        rows.append((i, wrong, off, took, took, ms["setup"], ms["exec"], ms["exec"] + ms["readback"], ms["readback"], params.k, [r for r, _ in exact], [v for _, v in exact], [r for r, _ in got], [v for _, v in got]))
        if params.debug:
            print(f"iteration {i}: {wrong} rows differ, exact {took:.1f} ms, {params.impl} {ms['exec']:.1f} ms", file=sys.stderr)
    index.close()
    return spark.createDataFrame(rows, SCHEMA)


def sweep(spark: SparkSession, folder: str, matrices: Iterable[str], options: dict[str, Iterable], cores: int = 1) -> list[str]:
    """A log in ``folder`` for every matrix and every combination of options (names of :class:`Params`); their paths.
    A log's name holds its setting, in the order in which the log reader takes it apart."""
    paths = []
    for path, values in product(matrices, product(*options.values())):
        p = Params(matrix=path, **dict(zip(options, values, strict=True)))
        log = run(spark, p)
        name = path.rstrip("/").split("/")[-1].removesuffix(".mtx").replace("_", "-") or "random"
        paths.append(f"{folder}/spark_{name}_0_matrix_0_{p.width}_{cores}_0_{p.k}_{p.iterations}_{p.impl}_{p.parts}_{p.keep}.csv")
        write_log(log, paths[-1], "fpga")
    return paths


def main(argv: Sequence[str]) -> int:
    """Run one setting and print its means."""
    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    log = run(spark, parse(argv))
    log.selectExpr("avg(error_idx) AS rows_differ", "avg(error_val) AS values_differ", "avg(sw_full_time_ms) AS exact_ms", "avg(hw_exec_time_ms) AS search_ms", "avg(readback_time_ms) AS readback_ms").show()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
