"""Applications into claims, and claims into accepted spellings."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriframe.config import ABV_MOST, ABV_STEP, ABV_TOLERANCE, BEER_STEP, ML_PER_FL_OZ, NET_TOLERANCE
from veriframe.functions import text as T
from veriframe.staging import dealt, staged

# Printed forms of an alcohol content, {n} the figure; the last five at twice the percentage.
ABV_FORMS = (
    "{n}% Alc./Vol.", "{n}% ALC./VOL.", "{n}% alc./vol.", "{n}% Alc/Vol", "{n}% ALC/VOL", "{n}% alc/vol", "{n} % ALC/VOL", "{n}% ABV", "{n}% abv",
    "ALC. {n}% BY VOL.", "Alc. {n}% by Vol.", "ALC {n}% BY VOL", "Alc {n}% by Vol.", "ALC {n}% BY VOL.", "{n}% ALC BY VOL", "{n}% Alc by Vol", "{n}% alc. by vol.", "{n}% ALC. BY VOL.",
    "ALC. BY VOL. {n}%", "Alc. by Vol. {n}%", "ALCOHOL {n}% BY VOLUME", "Alcohol {n}% by volume", "Alcohol {n} percent by volume", "Alc. {n} percent by vol.", "{n} percent alcohol by volume",
    "Alcohol by volume {n} percent", "Alcohol by volume: {n} percent", "{n}% Alcohol by Volume", "{n}% alcohol by vol.",
)
PROOF_FORMS = ("{n} Proof", "({n} Proof)", "{n} PROOF", "({n} PROOF)", "PROOF {n}")
# Printed forms of net contents in millilitres, litres and fluid ounces.
ML_FORMS = ("{n} mL", "{n} ml", "{n} ML", "{n}mL", "{n}ml", "{n}ML", "({n} ML)", "({n} mL)", "({n} ml)")
LITRE_FORMS = ("{n} L", "{n}L", "{n} Liter", "{n} LITER", "{n} Litre")
ML_WORDS = ("{n} milliliters", "{n} Milliliters", "{n} MILLILITERS")
OUNCE_FORMS = ("{n} FL OZ", "{n} FL. OZ.", "{n} fl oz", "{n} fl. oz.", "{n} Fl. Oz.")
# Standards of fill in millilitres.
FILLS = (50, 100, 187, 200, 375, 500, 700, 750, 1000, 1750)
BEER_FILLS = (207, 237, 296, 330, 331, 350, 355, 375, 473, 500, 568, 650, 710, 750, 946, 1000)
# Prescribed phrases before the responsible party's name.
PHRASES = (
    "Bottled by", "Bottled for", "Produced and Bottled by", "Produced by", "Distilled by", "Distilled and Bottled by", "Blended and Bottled by", "Blended by", "Vinted and Bottled by", "Cellared and Bottled by",
    "Made and Bottled by", "Manufactured by", "Packed by", "Prepared by", "Brewed by", "Brewed and Bottled by", "Brewed and Canned by", "Canned by", "Canned for", "Brewed and Packaged by", "Packaged by",
    "Imported by", "Imported and Bottled by", "Sole Agent",
)

ABV_FORMATS = [(t, 1.0) for t in ABV_FORMS] + [(t, 0.5) for t in PROOF_FORMS]
NET_FORMATS = [(t, 1.0) for t in ML_FORMS] + [(t, 1000.0) for t in LITRE_FORMS] + [(t, 1.0) for t in ML_WORDS] + [(t, ML_PER_FL_OZ) for t in OUNCE_FORMS]
BEVERAGES = ("spirits", "wine", "beer")

APPLICATION = "label string, beverage string, brand string, class string, producer array<string>, origin string, abv double, net_ml double, aliases map<string,array<string>>"


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _formats(rows: list[tuple[str, float]]) -> Column:
    return F.from_json(F.lit(json.dumps([{"template": t, "scale": s} for t, s in rows])), "array<struct<template:string,scale:double>>")


def abv_grid(step: float) -> Column:
    """The grid as one literal; a sequence and a rounding would be computed anew for each row."""
    n = int(ABV_MOST / step + 1e-6)
    places = [Decimal(repr(k * step)).quantize(Decimal("0.01"), ROUND_HALF_UP) for k in range(1, n + 1)]
    return F.split(F.lit(",".join(map(str, places))), ",").cast("array<double>")


def admit(valid: Column, want: Column, tolerance: Column) -> Column:
    """The vocabulary, with the filed value at its end where no value is within the tolerance."""
    return F.when(F.exists(valid, lambda v: F.abs(v - want) <= tolerance), valid).otherwise(F.concat(valid, F.array(want)))


def responsibility_forms(name: Column, address: Column) -> Column:
    """The name alone or after a prescribed phrase, alone or before a tail of up to four words of the address."""
    words = F.filter(F.split(F.trim(F.coalesce(address, F.lit(""))), r"\s+"), lambda w: w != "")
    n = F.size(words)
    tails = F.when(n > 0, F.transform(F.sequence(F.greatest(n - 3, F.lit(1)), n), lambda k: F.concat(F.lit(" "), F.array_join(F.slice(words, k, n - k + 1), " "))))
    tails = F.concat(F.array(F.lit("")), F.coalesce(tails, F.array().cast("array<string>")))
    phrases = F.array(F.lit(""), *[F.lit(p + " ") for p in PHRASES])
    return F.flatten(F.transform(tails, lambda t: F.transform(phrases, lambda p: F.concat(p, name, t))))


def claims(applications: DataFrame) -> DataFrame:
    """One row for each claim that an application files, in order.

    Columns: label, claim_pos, claim, expected, required, texts (accepted spellings of a text claim),
    numeric (null for text): formats, valid, tolerance. Empty texts and zero numbers file nothing.
    """
    none = F.lit(None).cast("struct<formats:array<struct<template:string,scale:double>>,valid:array<double>,tolerance:double>")
    texts = "array<string>"
    empty = F.array().cast(texts)

    def filed(name: str, there: Column, expected: Column, required: Column) -> Column:
        return F.when(there, F.struct(F.lit(name).alias("claim"), expected.alias("expected"), required.alias("required")))

    def spelt(name: str, value: Column, more: Column = empty) -> Column:
        return F.concat(F.array(value), F.coalesce(F.col("aliases")[name], empty), T.other_spellings(value), more)

    def number(value: Column, formats: list, valid: Column, tolerance: float) -> Column:
        return F.struct(_formats(formats).alias("formats"), admit(valid, value, F.lit(tolerance)).alias("valid"), F.lit(tolerance).alias("tolerance"))

    beer = F.coalesce(F.col("beverage") == "beer", F.lit(False))
    producer = lambda k: F.get("producer", F.lit(k))
    forms = responsibility_forms(producer(0), producer(1))
    alias_forms = F.flatten(F.transform(F.coalesce(F.col("aliases")["producer_1"], empty), lambda a: responsibility_forms(a, producer(1))))
    values = {"brand": F.col("brand"), "class": F.col("class"), "producer_1": producer(0), "producer_2": producer(1), "origin": F.col("origin")}
    numbers = {"abv": (F.col("abv"), ~beer), "net": (F.col("net_ml"), F.lit(True))}
    rows = [filed(k, F.coalesce(v, F.lit("")) != "", v, F.lit(k != "origin")) for k, v in values.items()]
    rows += [filed(k, v > 0, T.shortest(v), required) for k, (v, required) in numbers.items()]
    listed = F.filter(F.array(*rows), lambda c: c.isNotNull())
    # What is long is made after the rows are, and only where it is read.
    each = applications.select("*", F.posexplode(listed).alias("claim_pos", "c"))
    accepted, numeric = F.lit(None).cast(texts), none
    for k, v in values.items():
        accepted = F.when(F.col("c.claim") == k, spelt(k, v, F.concat(forms, alias_forms) if k == "producer_1" else empty)).otherwise(accepted)
    abv = number(F.col("abv"), ABV_FORMATS, F.when(beer, abv_grid(BEER_STEP)).otherwise(abv_grid(ABV_STEP)), ABV_TOLERANCE)
    net = number(F.col("net_ml"), NET_FORMATS, F.when(beer, _doubles(BEER_FILLS)).otherwise(_doubles(FILLS)), NET_TOLERANCE)
    numeric = F.when(F.col("c.claim") == "abv", abv).when(F.col("c.claim") == "net", net).otherwise(none)
    return each.select("label", "claim_pos", "c.*", F.coalesce(accepted, empty).alias("texts"), numeric.alias("numeric"))


def why_not_verifiable(beverage: Column, filed: Column) -> Column:
    """The reason an application is refused, or null: an unknown beverage, or claims without a beverage."""
    named = F.coalesce(beverage, F.lit("")) != ""
    return F.when(named & ~beverage.isin(*BEVERAGES), F.concat(F.lit("unknown beverage "), beverage)).when(~named & filed, F.lit("claims without a beverage"))


def candidates(filed: DataFrame) -> DataFrame:
    """One row for each accepted spelling: label, claim, cand_idx, text, norm, value, name, claimed, form, num.

    Spellings of one normalized text are one, the first. Of a numeric field these are the spellings
    of values within the tolerance of the filed one; ``lists`` has the others by figure.
    """
    text = filed.filter("numeric is null").select("label", "claim", "expected", F.posexplode("texts").alias("cand_idx", "text"))
    text = text.withColumn("norm", T.normalize("text")).filter("norm <> ''")
    first = F.row_number().over(Window.partitionBy("label", "claim", "norm").orderBy("cand_idx"))
    text = text.withColumn("k", first).filter("k = 1").select("label", "claim", "cand_idx", "text", "norm", F.lit(0.0).alias("value"), F.col("expected").alias("name"), F.lit(True).alias("claimed"), F.lit(-1).alias("form"), F.lit("").alias("num"))

    number = within(*numeric(filed))
    return text.unionByName(number.select("label", "claim", "cand_idx", "text", "norm", "value", "name", F.lit(True).alias("claimed"), "form", "num"))


def within(specs: DataFrame, words: DataFrame) -> DataFrame:
    """Spellings of the values within the tolerance of a filed one, by an equi-join on stretches of twice the tolerance."""
    stretch = lambda v: F.floor(v / (2 * F.col("tolerance")))
    around = F.array_distinct(F.array(stretch(F.col("want") - F.col("tolerance")), stretch(F.col("want") + F.col("tolerance"))))
    near = specs.withColumn("at", F.explode(around)).join(words.withColumn("at", stretch(F.col("value"))).drop("tolerance"), ["vocabulary", "at"])
    return near.filter(F.abs(F.col("value") - F.col("want")) <= F.col("tolerance"))


def _hashed(*columns: str) -> Column:
    """128 bits of a hash."""
    return F.concat_ws("-", F.xxhash64(*columns).cast("string"), F.xxhash64(F.lit(1), *columns).cast("string"))


def listed() -> Column:
    """The key of a claim's list of spellings. A list is long and often shared by many claims, so only its key goes along with a claim."""
    number = F.concat_ws("|", F.lit("="), _hashed("numeric"), F.col("expected").cast("double").cast("string"))
    return F.when(F.col("numeric").isNotNull(), number).otherwise(_hashed("expected", "texts"))


def figured() -> Column:
    """The key of the spellings of a vocabulary's values with one figure."""
    return F.concat_ws("|", F.lit("#"), "vocabulary", "num")


def packed(spellings: DataFrame) -> DataFrame:
    """(set, spellings): a row for each list."""
    return spellings.groupBy("set").agg(F.collect_list(F.struct("cand_idx", "text", "norm", "value", "name", "claimed", "form", "num")).alias("spellings"))


def others(words: DataFrame) -> DataFrame:
    """The lists of figures, as ``packed`` gives them."""
    return packed(words.select(figured().alias("set"), "cand_idx", "text", "norm", "value", "name", F.lit(False).alias("claimed"), "form", "num"))


def lists(filed: DataFrame, numbers: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The distinct lists of spellings, as ``packed`` gives them: the claims' own (``listed``), and those of figures (``figured``).

    ``numbers`` as ``numeric`` gives them. Of a list that many claims share each spelling is normalized once.
    """
    specs, words = numbers
    text = filed.filter("numeric is null").select(listed().alias("set"), "expected", "texts").dropDuplicates(["set"])
    text = text.select("set", "expected", F.posexplode("texts").alias("cand_idx", "text")).withColumn("norm", T.normalize("text")).filter("norm <> ''")
    first = F.row_number().over(Window.partitionBy("set", "norm").orderBy("cand_idx"))
    text = text.withColumn("k", first).filter("k = 1").select("set", "cand_idx", "text", "norm", F.lit(0.0).alias("value"), F.col("expected").alias("name"), F.lit(True).alias("claimed"), F.lit(-1).alias("form"), F.lit("").alias("num"))
    own = within(specs.select("vocabulary", "want", "tolerance").distinct(), words)
    own = own.select(F.concat_ws("|", F.lit("="), "vocabulary", F.col("want").cast("string")).alias("set"), "cand_idx", "text", "norm", "value", "name", F.lit(True).alias("claimed"), "form", "num")
    return packed(text).unionByName(packed(own)).unionByName(others(words))


def numeric(filed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numeric claims with the key of their vocabulary, and the spellings of each distinct vocabulary; both as tables.

    A vocabulary is long and shared by many claims, so only its key, 128 bits of a hash, goes along with a claim.
    """
    specs = staged(filed.filter("numeric is not null").select("label", "claim", *specified()))
    return specs, vocabularies(filed, specs)


def specified() -> list[Column]:
    """What goes along with a numeric claim; null for text."""
    number = F.col("numeric").isNotNull()
    return [F.when(number, F.col("expected").cast("double")).alias("want"), F.col("numeric.tolerance").alias("tolerance"), F.when(number, _hashed("numeric")).alias("vocabulary")]


def vocabularies(filed: DataFrame, specs: DataFrame) -> DataFrame:
    """The spellings of each distinct vocabulary, as a table; its values are read again from one claim that has it."""
    full = filed.filter("numeric is not null")
    first = specs.groupBy("vocabulary", "claim").agg(F.min("label").alias("label")).groupBy("vocabulary").agg(F.min(F.struct("label", "claim")).alias("r"))
    first = staged(first.select("vocabulary", "r.*"))
    one = full.join(first, ["label", "claim"]).filter(_hashed("numeric") == F.col("vocabulary")).select("vocabulary", "numeric.formats", "numeric.valid", "numeric.tolerance")
    one = staged(one.dropDuplicates(["vocabulary"]))
    return staged(vocabulary(dealt(one, "vocabulary")).join(one.select("vocabulary", "tolerance"), "vocabulary"))


def vocabulary(specs: DataFrame, key: str = "vocabulary") -> DataFrame:
    """Spellings of each numeric field (key, formats, valid): value by value, form by form, printing by printing, the first of each normalized text."""
    values = specs.select(key, "formats", F.posexplode("valid").alias("vi", "value"))
    forms = values.select(key, "vi", "value", F.posexplode("formats").alias("form", "f"))
    printed = F.when(F.col("f.scale") != 0, F.col("value") / F.col("f.scale")).otherwise(F.col("value"))
    spelt = forms.select(key, "vi", "value", "form", F.col("f.template").alias("template"), F.posexplode(T.printings(printed)).alias("pi", "s"))
    spelt = spelt.withColumn("text", F.replace("template", F.lit("{n}"), F.col("s"))).withColumn("norm", T.normalize("text"))
    order = F.row_number().over(Window.partitionBy(key, "norm").orderBy("vi", "form", "pi"))
    one = spelt.filter("norm <> ''").withColumn("k", order).filter("k = 1")
    return one.select(key, (F.col("vi") * 10000 + F.col("form") * 100 + F.col("pi")).alias("cand_idx"), "text", "norm", "value", T.shortest("value").alias("name"), "form", T.normalize("s").alias("num"))


def field_vocabulary(spark: SparkSession, field: str) -> DataFrame:
    """The spellings of ``abv``, ``abv_beer``, ``net`` or ``net_beer`` without a filed value."""
    formats = ABV_FORMATS if field.startswith("abv") else NET_FORMATS
    valid = {"abv": abv_grid(ABV_STEP), "abv_beer": abv_grid(BEER_STEP), "net": _doubles(FILLS), "net_beer": _doubles(BEER_FILLS)}[field]
    return vocabulary(spark.range(1).select(F.lit(field).alias("vocabulary"), _formats(formats).alias("formats"), valid.alias("valid")))
