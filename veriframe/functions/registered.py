"""The engine's functions by name, for use in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from veriframe.config import DEFAULT, MAX_FOLLOW, MAX_RUN
from veriframe.functions import batch
from veriframe.functions import text as T
from veriframe.operators.geometry import order_of_reading
from veriframe.operators.reference import beside_or_under

# Types, not their names, which can only be read with a session.
CHAIN = StructType().add("label", StringType()).add("path", ArrayType(IntegerType())).add("text", StringType())
for _name in ("x0", "y0", "x1", "y1", "parts"):
    CHAIN = CHAIN.add(_name, IntegerType())


def _share(kernel: Callable[[list[str], list[str]], np.ndarray]):
    """Half edits of the pairs as a share of the claim's own length: 1 for an empty claim, null where a side is."""

    @pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            there = (a.notna() & b.notna()).to_numpy()
            claim, read = a[there], b[there].tolist()
            n = claim.str.len().to_numpy(dtype="int64") if len(claim) else np.zeros(0, np.int64)
            out = np.full(len(a), np.nan)
            out[there] = np.where(n > 0, kernel(claim.tolist(), read) / (2.0 * np.maximum(n, 1)), 1.0)
            yield pd.Series(out).astype("Float64").mask(~there)

    return run


claim_distance = _share(lambda claims, reads: batch.half_edits(claims, reads, DEFAULT.half_cost))
claim_infix = _share(lambda claims, reads: batch.infix(claims, reads, DEFAULT.half_cost)[0])


@udtf(returnType=CHAIN)
class ClaimChains:
    """Chains of the detections of one label: give it a table with label, det_idx, x0, y0, x1, y1 and text, partitioned by label."""

    def __init__(self):
        self.rows = []
        self.label = None

    def eval(self, row):
        self.label = str(row["label"])
        self.rows.append((row["det_idx"], (row["x0"], row["y0"], row["x1"], row["y1"]), row["text"]))

    def terminate(self):
        rows = sorted(self.rows)
        boxes = [b for _, b, _ in rows]
        order = order_of_reading(boxes)
        after = {i: [j for j in order if j != i and beside_or_under(boxes[i], boxes[j])][:MAX_FOLLOW] for i in order}
        chains = [[i] for i in order]
        while chains:
            longer = []
            for c in chains:
                b = [boxes[i] for i in c]
                yield self.label, [rows[i][0] for i in c], " ".join(rows[i][2] for i in c), min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b), len(c)
                if len(c) < MAX_RUN:
                    longer += [[*c, j] for j in after[c[-1]]]
            chains = longer


def register(spark: SparkSession) -> None:
    """``claim_normalize(text)``, ``claim_distance(claim, read)``, ``claim_infix(claim, read)`` of normalized texts, and the table function ``claim_chains``."""
    # In SQL itself, so the optimizer sees through it; the steps are those of text.normalize.
    upper = f"translate(upper(replace(s, 'ß', 'S')), '{T.MARKED}', '{T.PLAIN}')"
    mark = "'\\u0001'"
    held = rf"regexp_replace({upper}, r'(?<=\p{{Nd}})[.,](?=\p{{Nd}})', {mark})"
    body = rf"translate(regexp_replace({held}, r'[^\p{{L}}\p{{Nd}}\x01]', ''), {mark}, '.')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION claim_normalize(s STRING) RETURNS STRING RETURN {body}")
    spark.udf.register("claim_distance", claim_distance)
    spark.udf.register("claim_infix", claim_infix)
    spark.udtf.register("claim_chains", ClaimChains)
