"""Matching entities of two sources without a common key: bit vectors of q-grams, multi-index Hamming hashing, calibrated confidence.

The q-grams of a name and of a street become vectors of ``BITS`` bits, kept as four 64-bit chunks. Two vectors within
``RADIUS`` differ by at most one bit in one of their chunks, so a query that probes each chunk and its 64 one-bit
neighbours meets every close vector in an equi-join, and few others. Close names are looked for at one place, close
streets at one street number. What a candidate says of each field (Dice coefficients) is gathered per entity, weighted,
and turned into a confidence by a logistic fit on pairs of records whose identity is known; the confidence decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.llm.addresses import parse_address, same_name
from inspectra.llm.survivorship import UNKNOWN
from inspectra.session import checkpoint

BITS, CHUNKS = 256, 4
#: Of so many differing bits one chunk of four holds one at most.
RADIUS = 2 * CHUNKS - 1
#: Legal forms, articles and words that only say "restaurant": they tell nothing of which business it is.
GENERIC = frozenset(
    "the inc corp llc ltd llp lp incorporated corporation company limited restaurant restaurants rest ristorante eatery nyc ny fl and at of l c".split()
)
SHORT = {
    "hse": "house", "caffe": "cafe", "kitch": "kitchen", "ktchn": "kitchen", "bkry": "bakery", "rstrnt": "restaurant",
    "ctr": "center", "mkt": "market", "hosp": "hospitality", "grp": "group",
}
#: Distances in km: one spot, and the width of a cell of the grid in degrees (wider than a spot at every latitude to 72).
SPOT_KM, CELL = 0.3, 0.01
#: Words in this share of the names count as frequent; so few can be that the driver holds them.
FREQUENT = 1e-4
#: Records of known identity by which confidences are calibrated, at most (chosen by a hash).
SAMPLE = 2_000
#: Pairs of either kind that a calibration needs.
LEAST = 20
FIELDS = ["name", "inside", "core", "name_unknown", "address", "address_unknown", "postal", "postal_unknown", "near", "spot_unknown", "town_differs"]
_NOT_WORD = re.compile(r"[\W_]+")


def name_words(name: str | None) -> list[str]:
    """The telling words of a name: without accents, case, punctuation, legal and generic words; all words if none is left."""
    if not isinstance(name, str) or name.strip().lower() in UNKNOWN:
        return []
    s = "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))
    words = [SHORT.get(w, w) for w in _NOT_WORD.split(s.replace("'", "").replace("’", "")) if w]
    return [w for w in words if w not in GENERIC] or words


_places: dict[str, int] = {}


def _place_of(gram: str) -> int:
    if gram not in _places:
        if len(_places) > 100_000:
            _places.clear()
        _places[gram] = zlib.crc32(gram.encode()) % BITS
    return _places[gram]


def bit_vector(words: list[str]) -> list[int]:
    """Four signed 64-bit chunks with a bit for each two-letter piece of each padded word, whatever the order of words."""
    chunks = [0] * CHUNKS
    for w in words:
        p = f"_{w}_"
        for i in range(len(p) - 1):
            at = _place_of(p[i : i + 2])
            chunks[at % CHUNKS] |= 1 << (at // CHUNKS)
    return [c - (1 << 64) if c >= 1 << 63 else c for c in chunks]


_VECTORS = ("name", "core", "street")
_ENCODED = "struct<" + ",".join(
    [f"{v}{k}:bigint" for v in _VECTORS for k in range(CHUNKS)]
    + [f"{c}:string" for c in ("number", "street", "kind", "direction", "town", "zip")]) + ">"


def _encoder(frequent: dict[str, int]):
    """Encodes a row; the core of a name is the vector of its rarest word (the first of those about as rare)."""
    def encode(name: pd.Series, address: pd.Series, city: pd.Series, postal: pd.Series) -> pd.DataFrame:
        rows = []
        for n, a, c, p in zip(name, address, city, postal):
            words = name_words(n)
            core = [min(words, key=lambda w: (frequent.get(w, 0) + 1).bit_length())] if words else []
            place = parse_address(a, c if isinstance(c, str) else None, p if isinstance(p, str) else None)
            known = place["number"] is not None and place["name"] is not None
            street = bit_vector([place["name"]] if known else [])
            rows.append((*bit_vector(words), *bit_vector(core), *street, place["number"] if known else None, place["name"] if known else None,
                         place["kind"], place["direction"], place["town"], place["zip"]))
        return pd.DataFrame(rows, columns=[x.split(":")[0] for x in _ENCODED[7:-1].split(",")])

    return F.pandas_udf(encode, _ENCODED)


@dataclass(frozen=True)
class Source:
    """The attributes of one side by column name; ``columns`` are carried along (ids and entity)."""

    df: DataFrame
    columns: tuple[str, ...]
    name: str
    address: str
    city: str
    postal: str
    latitude: str
    longitude: str


def frequent_words(sources: list[Source], share: float = FREQUENT) -> dict[str, int]:
    """The words that at least ``share`` of all names hold, with their number of names (``words a name / share`` entries at most)."""
    split = F.pandas_udf(lambda s: s.map(lambda n: sorted(set(name_words(n)))), "array<string>")
    words = None
    for s in sources:
        one = s.df.select(F.explode(split(F.col(s.name).cast("string"))).alias("word"))
        words = one if words is None else words.unionByName(one)
    total = sum(s.df.count() for s in sources)
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, math.ceil(share * total)))
    return {r["word"]: r["n"] for r in counts.collect()}


def encode(source: Source, frequent: dict[str, int]) -> DataFrame:
    """The carried columns and the encoded attributes. Coordinates that are 0, out of range or no numbers count as missing."""
    text = lambda c: F.col(c).cast("string")
    lat, lon = F.col(source.latitude).try_cast("double"), F.col(source.longitude).try_cast("double")
    good = (F.abs(lat) > 0.01) & (F.abs(lat) <= 90) & (F.abs(lon) > 0.01) & (F.abs(lon) <= 180)
    d = source.df.select(
        *source.columns, F.when(good, lat).alias("lat"), F.when(good, lon).alias("lon"),
        _encoder(frequent)(text(source.name), text(source.address), text(source.city), text(source.postal)).alias("e"))
    return d.select(*source.columns, "lat", "lon", "e.*")


def ones(*chunks: Column) -> Column:
    out = F.bit_count(chunks[0])
    for c in chunks[1:]:
        out = out + F.bit_count(c)
    return out


def vector(v: str, side: str = "") -> list[Column]:
    return [F.col(f"{side}{v}{k}") for k in range(CHUNKS)]


def hamming(a: list[Column], b: list[Column]) -> Column:
    return ones(*[x.bitwiseXOR(y) for x, y in zip(a, b)])


def _shared(a: list[Column], b: list[Column]) -> Column:
    return ones(*[x.bitwiseAND(y) for x, y in zip(a, b)])


def dice(a: list[Column], b: list[Column]) -> Column:
    """Dice coefficient of two bit vectors; NULL if either is empty."""
    x, y = ones(*a), ones(*b)
    return F.when((x > 0) & (y > 0), 2.0 * _shared(a, b) / (x + y))


def overlap(a: list[Column], b: list[Column]) -> Column:
    """The share of the smaller vector's bits that the other one has; NULL if either is empty."""
    least = F.least(ones(*a), ones(*b))
    return F.when(least > 0, _shared(a, b) / least)


def _held(a: list[Column], b: list[Column]) -> Column:
    """The share of a's bits that b has; NULL if either is empty."""
    return F.when((ones(*a) > 0) & (ones(*b) > 0), _shared(a, b) / ones(*a))


def _spots(query: bool) -> list[Column]:
    """The places at which a name is looked for: cells of the grid where both sides have coordinates, the postal code where
    not, the town where neither can be compared. Queries take the cells that their spot touches, the index its own."""
    d = SPOT_KM / 111.0 if query else 0.0
    no_spot, no_zip = F.col("lat").isNull(), F.col("zip").isNull()
    lon_d = F.lit(d) / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    cell = lambda i, j: F.concat_ws("|", F.lit("c"), F.floor((F.col("lat") + i * d) / CELL).cast("string"), F.floor((F.col("lon") + j * lon_d) / CELL).cast("string"))
    cells = [F.when(~no_spot, cell(i, j)) for i in ((-1, 1) if query else (0,)) for j in ((-1, 1) if query else (0,))]
    at_zip, at_town = (lambda k: F.concat(F.lit(f"z{k}|"), F.col("zip"))), (lambda k: F.concat(F.lit(f"t{k}|"), F.col("town")))
    if query:
        return [*cells, F.when(no_spot, at_zip(1)).otherwise(at_zip(0)),
                F.when(no_spot & no_zip, at_town(2)).when(no_spot, at_town(1)).when(no_zip, at_town(3)).otherwise(at_town(0))]
    return [*cells, F.when(no_spot, at_zip(0)), at_zip(1), F.when(no_spot & no_zip, at_town(0)), F.when(no_zip, at_town(1)), at_town(2), F.when(no_spot, at_town(3))]


def _keys(df: DataFrame, ids: list[str], query: bool) -> DataFrame:
    """One row a vector, place and chunk (for queries also each of its one-bit neighbours): ids, the vector, the hash it meets by."""
    places = F.array_distinct(F.array_compact(F.array(*_spots(query))))
    named = df.where(ones(*vector("name")) > 0).select(*ids, F.explode(places).alias("at"), *[c.alias(f"v{k}") for k, c in enumerate(vector("name"))])
    streets = df.where("number IS NOT NULL").select(*ids, F.concat(F.lit("n|"), F.col("number")).alias("at"), *[c.alias(f"v{k}") for k, c in enumerate(vector("street"))])
    each = named.unionByName(streets)
    each = each if query else each.distinct()  # copies of a record meet as one
    if query:
        flips = F.sequence(F.lit(-1), F.lit(63))
        near = lambda k: F.transform(flips, lambda i: F.struct(
            F.lit(k).alias("k"), F.when(i < 0, F.col(f"v{k}")).otherwise(F.col(f"v{k}").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(i, F.lit(0))))).alias("c")))
        keys = F.concat(*[near(k) for k in range(CHUNKS)])
    else:
        keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("c")) for k in range(CHUNKS)])
    each = each.select(*ids, "at", *[f"v{k}" for k in range(CHUNKS)], F.explode(keys).alias("x"))
    return each.select(*ids, *[f"v{k}" for k in range(CHUNKS)], F.xxhash64("at", "x.k", "x.c").alias("key"))


def close_vectors(queries: DataFrame, index: DataFrame, query_id: str, entity: str) -> DataFrame:
    """``(query_id, entity)``: exactly the pairs with a name at one place or a street at one number within ``RADIUS`` bits.

    The equi-join meets a pair once for each chunk in which it differs by a bit or none; the distance is checked there.
    """
    q = _keys(queries, [query_id], True).select(query_id, "key", *[F.col(f"v{k}").alias(f"q{k}") for k in range(CHUNKS)])
    # a row a chunk and place: far more than the size of the tables lets expect, so neither side may be broadcast
    met = q.hint("merge").join(_keys(index, [entity], False).hint("merge"), "key")
    close = met.where(hamming([F.col(f"q{k}") for k in range(CHUNKS)], [F.col(f"v{k}") for k in range(CHUNKS)]) <= RADIUS)
    return close.select(query_id, entity).distinct()


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))  # least() passes over NULL


def evidence(candidates: DataFrame, queries: DataFrame, index: DataFrame, query_id: str, record: str, entity: str) -> DataFrame:
    """What all records of an entity together say about a query, one number between 0 and 1 a field of ``FIELDS``.

    The best value of each field counts. An address is as similar as its street if the number agrees and nothing
    contradicts, else 0; ``*_unknown`` tells that no record lets a field be compared. The query's own record, if it is
    in the index, is left out.
    """
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns if c != query_id], query_id, F.col(query_id).alias("_own"))
    j = candidates.join(q, query_id).join(index, entity).where(F.col("_own") != F.col(record))
    col, own = F.col, (lambda c: F.col(f"q_{c}"))
    agree = lambda c: own(c).isNull() | col(c).isNull() | (own(c) == col(c))
    both = lambda c: own(c).isNotNull() & col(c).isNotNull()
    street = F.greatest(dice(vector("street", "q_"), vector("street")), F.when(same_name(own("street"), col("street")), F.lit(0.9)))
    fits = (own("number") == col("number")) & agree("kind") & agree("direction") & agree("town")
    km = distance_km(own("lat"), own("lon"), col("lat"), col("lon"))
    best = {
        "name": dice(vector("name", "q_"), vector("name")), "inside": overlap(vector("name", "q_"), vector("name")), "core": F.greatest(_held(vector("core", "q_"), vector("name")), _held(vector("core"), vector("name", "q_"))),
        "address": F.when(both("number"), F.when(fits, street).otherwise(0.0)), "postal": F.when(both("zip"), (own("zip") == col("zip")).cast("double")),
        "near": F.when(km.isNotNull(), F.exp(-F.pow(km / SPOT_KM, F.lit(2.0)))), "town_same": F.when(both("town"), (own("town") == col("town")).cast("double")),
    }
    g = j.groupBy(query_id, entity).agg(*[F.max(c).alias(k) for k, c in best.items()], F.min(km).alias("km"))
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    unknown = lambda c: F.col(c).isNull().cast("double")
    return g.select(
        query_id, entity, unknown("name").alias("name_unknown"), known("name"), known("inside"), known("core"), known("address"), unknown("address").alias("address_unknown"), known("postal"),
        unknown("postal").alias("postal_unknown"), known("near"), unknown("near").alias("spot_unknown"), (F.coalesce("town_same", F.lit(1.0)) == 0).cast("double").alias("town_differs"), "km")


def _alike() -> Column:
    return (F.col("name") + F.col("inside") + F.col("core")) / 3


def _place() -> Column:
    """The address where it is known; else the spot; else the postal code; half where only the town can be compared."""
    f = F.col
    code = F.greatest(f("postal"), 0.5 * f("postal_unknown") * (1 - f("town_differs")))
    return F.greatest(f("address"), f("address_unknown") * F.greatest(f("near"), f("spot_unknown") * code))


def _features() -> Column:
    """The fields, and the products of name and place that tell a namesake elsewhere and another tenant from the entity itself."""
    place, alike = _place(), _alike()
    clearly = [F.greatest(F.lit(0.0), alike - t) for t in (0.4, 0.6, 0.8)]
    return array_to_vector(F.array(*[F.col(c).cast("double") for c in FIELDS], place, place * alike, *clearly, *[place * c for c in clearly]))


@dataclass(frozen=True)
class Calibration:
    """Weights of the fields and the intercept of the logistic that makes a confidence of their weighted sum."""

    model: object

    def confidence(self, scored: DataFrame) -> DataFrame:
        out = self.model.transform(scored.withColumn("_features", _features()))
        return out.withColumn("confidence", vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_prediction")


def calibrate(labelled: DataFrame) -> Calibration | None:
    """Fitted on rows of ``evidence`` with a 0/1 column ``label``; None if either class has fewer than ``LEAST`` rows."""
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if min(n.get(0, 0), n.get(1, 0)) < LEAST:
        return None
    lr = LogisticRegression(featuresCol="_features", labelCol="label", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction", regParam=1e-3, standardization=False, maxIter=100)
    return Calibration(lr.fit(labelled.select(_features().alias("_features"), F.col("label").cast("double").alias("label"))))


def prior_confidence(scored: DataFrame) -> DataFrame:
    """Where too few records of known identity allow a calibration: how much the names are alike times what the place says."""
    return scored.withColumn("confidence", F.when(F.col("name_unknown") == 1, 0.0).otherwise(_place() * _alike()))


def link(left: Source, right: Source, *, left_id: str, right_id: str, entity: str, min_confidence: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``(left_id, entity, confidence)``: for each left row the entity of the right side it describes, if any.

    ``right`` may hold several records of one ``entity``; ``left_id`` and ``right_id`` are unique integers. Every pair of
    a left row and an entity that the index finds gets a confidence; the best one is taken if it reaches
    ``min_confidence`` (ties: the nearer, then the smaller entity). Confidences are calibrated on records of the right side, whose
    identity is known: each of at most ``sample`` records is searched among the others, and a pair is right if both have one
    entity. That tells tenants of one address and namesakes apart. Rows with neither name nor address
    meet nothing; NULLs in any attribute count as unknown; rows without an entity are left out. With too few known
    pairs the confidence is that of ``prior_confidence``. The result has the columns ``left_id``, ``entity``, ``confidence``.
    """
    right = Source(right.df.where(F.col(entity).isNotNull()), right.columns, right.name, right.address, right.city, right.postal, right.latitude, right.longitude)
    frequent = frequent_words([left, right])
    index = checkpoint(encode(right, frequent).withColumnRenamed(right_id, "_record").withColumnRenamed(entity, "_entity"))
    query = encode(left, frequent).withColumnRenamed(left_id, "_id").withColumn("_kind", F.lit(1)).withColumn("_truth", F.lit(None).cast(index.schema["_entity"].dataType))
    rate = min(1.0, sample / max(1, index.count()))
    known = index.where(F.pmod(F.xxhash64("_record"), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000)))
    known = known.withColumnRenamed("_record", "_id").withColumnRenamed("_entity", "_truth").withColumn("_kind", F.lit(0))
    # queries and known records are searched in one pass; ids of the two kinds may be equal, so they are told apart by the sign
    query = checkpoint(query.unionByName(known).withColumn("_query", F.when(F.col("_kind") == 1, -F.col("_id").cast("long") - 1).otherwise(F.col("_id").cast("long"))).drop("_id"))
    attributes = [c for c in query.columns if c not in ("_kind", "_truth")]
    found = close_vectors(query.select(attributes), index, "_query", "_entity")
    scored = checkpoint(evidence(found, query.select(attributes), index, "_query", "_record", "_entity"))
    labelled = scored.where("_query >= 0").join(query.where("_kind = 0").select("_query", "_truth"), "_query").withColumn("label", (F.col("_truth") == F.col("_entity")).cast("int"))
    fitted = calibrate(labelled)
    mine = scored.where("_query < 0")
    mine = prior_confidence(mine) if fitted is None else fitted.confidence(mine)
    best = F.min_by(F.struct("_entity", "confidence"), F.struct(-F.col("confidence"), F.coalesce("km", F.lit(1e6)), "_entity"))
    out = mine.where(F.col("confidence") >= min_confidence).groupBy((-F.col("_query") - 1).alias(left_id)).agg(best.alias("x"))
    return out.select(left_id, F.col("x._entity").alias(entity), "x.confidence")
