"""Matching spellings to readings and deciding claims.

Every candidate pair is aligned once, at the widest radius that any search uses. What a pair may
do for a claim (verify it, protect it by the margin, or contradict it) is a flag on the row, and
one aggregate takes the best row of each role. Spellings of the filed value meet the readings of their label
through an index of pieces, of which one must be read as it is (``meet.py``); numeric candidates that must be read
exactly are looked for where a reading holds the figure. All alignments of a batch are done at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from veriframe.config import DEFAULT, Options
from veriframe.functions import align, batch
from veriframe.functions import text as T
from veriframe.operators import claims as C
from veriframe.operators import meet
from veriframe.staging import shuffled, staged

FAR = batch.FAR


def match(claim: list[str], form: np.ndarray, text: list[str], norm: list[str], parts: np.ndarray, widest: np.ndarray, budget: np.ndarray, cc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair the half edits and the stretch of the reading that the spelling was matched against; ``FAR`` past the budget.

    A figure is bounded by its unit, so it may stand anywhere in the reading. Another spelling is held against the
    whole reading or, where that is closer, against a stretch that is delimited and whose ends are the spelling's.
    """
    n, read = np.array([len(s) for s in claim], np.int64), np.array([len(s) for s in norm], np.int64)
    figure = form >= 0
    cost, start, stop = np.full(len(n), FAR, np.int64), np.zeros(len(n), np.int64), np.where(figure, 0, read)
    folded = [s.translate(align._FOLD) for s in claim], [s.translate(align._FOLD) for s in norm]

    def possible(rows: np.ndarray, anywhere: bool) -> np.ndarray:
        own = rows.tolist()
        least = batch.least_edits([folded[0][i] for i in own], [folded[1][i] for i in own], np.full(len(own), anywhere))
        return rows[least <= budget[rows]]

    whole = possible(np.flatnonzero(~figure & (2 * np.abs(n - read) <= budget)), anywhere=False)
    cost[whole] = batch.half_edits([claim[i] for i in whole.tolist()], [norm[i] for i in whole.tolist()], cc)
    within = figure | ((n < read) & (read <= 3 * n + 24) & ((parts == 1) | (n > widest)))
    inside = possible(np.flatnonzero(within & (cost > 0)), anywhere=True)
    c, s, e = batch.infix([claim[i] for i in inside.tolist()], [norm[i] for i in inside.tolist()], cc)
    for k in np.flatnonzero(figure[inside] | ((c < cost[inside]) & (c <= budget[inside]))).tolist():
        i, stretch = int(inside[k]), (int(s[k]), int(e[k]))
        if not figure[i]:
            if not align.ends_meet(claim[i], norm[i][slice(*stretch)], cc):
                continue
            if not align.delimited(text[i], *T.normalize_with_offsets(text[i]), *stretch):
                continue
        cost[i], (start[i], stop[i]) = c[k], stretch
    return cost, start, stop


def radius_of(claims: DataFrame, options: Options) -> Column:
    base = F.when(F.col("numeric").isNotNull(), F.lit(options.numeric_radius)).otherwise(F.lit(options.radius))
    return F.when(F.col("radius") > 0, F.col("radius")).otherwise(base) if "radius" in claims.columns else base


def matches(links: DataFrame, lists: DataFrame, readings: DataFrame, buckets: int, options: Options = DEFAULT) -> DataFrame:
    """The best rows (label, claim, spelling, reading) of each role, with distance and stretch, some of them more than once.

    ``links`` (label, and of each claim set, radius, reach, and want, tolerance and num of a value that isn't claimed) say which list of spellings a
    claim is looked for by. Labels are dealt to buckets; of lists a bucket gets those that its claims have, each once.
    """
    cc = options.half_cost
    bucket = F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int").alias("bucket")
    links = staged(links.select(bucket, "*"))
    sets = links.select("bucket", F.explode("links.set").alias("set")).distinct()
    every = sets.join(shuffled(lists), "set").withColumn("kind", F.lit(meet.SPELLING))
    every = every.unionByName(links.withColumn("kind", F.lit(meet.LINK)), allowMissingColumns=True)
    every = every.unionByName(readings.select(bucket, F.lit(meet.READING).alias("kind"), "*"), allowMissingColumns=True)
    kinds = {"label": links.schema["label"].dataType} | {f.name: f.dataType for c in (lists.schema["spellings"], links.schema["links"], readings.schema["readings"]) for f in c.dataType.elementType.fields}
    kinds |= {"ctext": StringType(), "len": IntegerType(), "dist": DoubleType(), "start": IntegerType(), "stop": IntegerType(), "dropped": BooleanType(), "shortest": IntegerType()} | dict.fromkeys(meet.ROLES, BooleanType())
    names = ["label", "claim", "dist", "len", "cand_idx", "path", "ctext", "name", "num", "form", "box", "text", "confidence", "parts", "start", "stop", *meet.ROLES, "dropped", "shortest"]
    judge = lambda *pairs: match(*pairs, cc)
    ordered = every.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    return ordered.mapInArrow(meet.meeting(judge, options.tie_margin, names), StructType([StructField(c, kinds[c]) for c in names]))


def _best(role: str) -> Column:
    """The least by distance, then the longer spelling, the shorter stretch, and the first spelling and reading."""
    row = F.struct("dist", (-F.col("len")).alias("len"), (F.col("stop") - F.col("start")).alias("span"), "cand_idx", "path", "ctext", "name", "num", "form", "box", "text", "confidence", "parts", "start", "stop", "dropped", "shortest")
    return F.min(F.when(F.col(role), row))


def verdicts(claims: DataFrame, links: DataFrame, lists: DataFrame, readings: DataFrame, buckets: int, options: Options = DEFAULT) -> DataFrame:
    """One row for each claim: status, reason, expected, observed and evidence; the other tables as ``matches`` takes them."""
    found = matches(links, lists, readings, buckets, options)
    best = found.groupBy("label", "claim").agg(_best("is_exact").alias("e"), _best("is_own").alias("o"), _best("is_near").alias("n"), _best("is_other").alias("x"))
    best = staged(best)
    v = claims.withColumn("r", F.col("radius")).join(shuffled(best), ["label", "claim"], "left")
    e, o, n, x = (F.col(k) for k in "eonx")
    tie = options.tie_margin
    verified = e.isNotNull() & (x.isNull() | (e["dist"] <= x["dist"] + tie))
    mismatch = ~verified & x.isNotNull() & (o.isNull() | (x["dist"] + tie < o["dist"]))
    v = v.withColumn("verified", verified).withColumn("mismatch", mismatch)
    v = v.withColumn("win", F.when(F.col("verified"), e).otherwise(x)).withColumn("lose", F.when(F.col("verified"), x).otherwise(o))
    w = F.col("win")
    dropped = w["dropped"]
    short = o.isNotNull() & (w["shortest"] > 0) & (w["span"] < w["shortest"])
    start = F.when(F.col("required"), F.lit("NOT_FOUND")).otherwise(F.lit("SKIPPED"))
    status = F.when(w.isNull(), start).when(F.col("verified"), "VERIFIED").when(F.col("mismatch") & (dropped | short), "REVIEW").when(F.col("mismatch"), "MISMATCH").otherwise("REVIEW")
    reason = (
        F.when(w.isNull(), F.lit("not_found")).when(F.col("verified"), F.lit("")).when(F.col("mismatch") & dropped, F.lit("figure_incomplete")).when(F.col("mismatch") & short, F.lit("reading_short"))
        .when(F.col("mismatch"), F.concat(F.lit("read "), w["name"])).otherwise(F.concat(F.lit("between:"), o["name"], F.lit(","), x["name"]))
    )
    seen = F.coalesce(w, o, n)  # undecided: the nearest reading of the claim's own value
    seen = F.when(w.isNotNull() | (seen["dist"] <= 2 * F.col("r")), seen)
    lose = F.when(w.isNotNull(), F.col("lose"))
    at = T.offsets(seen["text"])
    evidence = F.when(
        seen.isNotNull(),
        F.struct(
            seen["box"].alias("region"), T.quote(seen["text"], at, seen["start"], seen["stop"], seen["text"]).alias("read"), seen["ctext"].alias("matched"), seen["dist"].alias("distance"), F.col("r").alias("radius"),
            seen["confidence"].alias("confidence"), lose["ctext"].alias("competitor"), lose["dist"].alias("competitor_distance"), F.when(w.isNotNull() & F.col("numeric").isNotNull(), w["name"]).alias("reading"), seen["parts"].alias("parts"),
        ),
    )
    return v.select("label", "claim", status.alias("status"), reason.alias("reason"), "expected", F.coalesce(w["name"], F.lit("")).alias("observed"), evidence.alias("evidence"))


def verify(detections: DataFrame, claims: DataFrame, candidates: DataFrame | None = None, options: Options = DEFAULT) -> DataFrame:
    """Verdicts of all claims from raw detections; a label on which nothing was read says so.

    Without ``candidates`` the accepted spellings are those of ``claims.candidates``, each distinct list of them made once.
    """
    from veriframe.operators import geometry

    # Each input is read many times below: as a table it is computed once, and plans stay small.
    kept = [c for c in claims.columns if c not in ("texts", "numeric", "claim_pos", "radius")]
    number = F.col("numeric").isNotNull()
    own = C.listed() if candidates is None else F.concat_ws("-", F.xxhash64("label", "claim").cast("string"), F.xxhash64(F.lit(1), "label", "claim").cast("string"))
    slim = staged(claims.select(*kept, F.when(number, F.lit(True)).alias("numeric"), radius_of(claims, options).alias("radius"), own.alias("set"), *C.specified()))
    specs = slim.filter("numeric").select("label", "claim", "want", "tolerance", "vocabulary", "radius")
    words = C.vocabularies(claims, specs)
    if candidates is None:
        lists = C.lists(claims, (specs, words))
    else:
        lists = C.packed(candidates.filter("claimed or num = ''").withColumn("set", own)).unionByName(C.others(words))
    # A row holds the readings that begin at some boxes of a label.
    runs = geometry.runs(detections, options).groupBy("label", F.floor(F.get("path", F.lit(0)) / 64).alias("part"))
    readings = staged(runs.agg(F.collect_list(F.struct("path", "box", "text", "norm", "confidence", "parts", "widest", "nums")).alias("readings")).drop("part"))
    # A claim looks for its own list and, where a reading of its label holds the figure of another value, for the spellings of that figure.
    reach = F.greatest(F.col("radius") + options.tie_margin, 2 * F.col("radius")).alias("reach")
    none = F.lit(None).cast("double")
    links = slim.select("label", "claim", "set", "radius", reach, none.alias("want"), none.alias("tolerance"), F.lit(None).cast("string").alias("num"))
    figures = readings.select("label", F.explode(F.flatten("readings.nums")).alias("num")).distinct()
    seen = specs.join(shuffled(figures), "label")
    links = links.unionByName(seen.select("label", "claim", C.figured().alias("set"), "radius", reach, "want", "tolerance", "num"))
    links = links.groupBy("label").agg(F.collect_list(F.struct("claim", "set", "radius", "reach", "want", "tolerance", "num")).alias("links"))
    parts, total = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), slim.count()
    buckets = max(1, min(parts, -(-total // 1024)), -(-total // meet.CLAIMS))
    out = verdicts(slim, links, staged(lists), readings, buckets, options)
    read = detections.select("label").distinct().withColumn("any", F.lit(True))
    blank = F.col("any").isNull() & F.col("status").isin("NOT_FOUND", "SKIPPED")
    return out.join(shuffled(read), "label", "left").withColumn("reason", F.when(blank, "no_text").otherwise(F.col("reason"))).drop("any")


def near_misses(verdicts_: DataFrame) -> DataFrame:
    """Boxes worth a second reading: undecided claims whose nearest reading lies between the radius and twice the radius, each box once."""
    d, r = F.col("evidence.distance"), F.col("evidence.radius")
    return verdicts_.filter(F.col("status").isin("NOT_FOUND", "REVIEW", "SKIPPED") & (d > r) & (d <= 2 * r)).select("label", F.col("evidence.region").alias("region")).dropDuplicates()
