"""Address records of one place: parsed components, a set-containment join for candidates, and a check for contradictions.

An address means a street number on a street (name, kind, direction) of a town. Units, floors and remarks do not
count; a component that is left out contradicts nothing. Names may be glued, hyphenated or misspelt.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.session import checkpoint

#: Street kinds with their short forms.
KINDS: dict[str, list[str]] = {
    "street": ["street", "st", "str", "strt", "streets"], "avenue": ["avenue", "ave", "av", "aven", "avenu", "avn"], "road": ["road", "rd"],
    "place": ["place", "pl", "plc"], "drive": ["drive", "dr", "drv", "driv"], "court": ["court", "ct", "crt"], "lane": ["lane", "ln", "la"],
    "boulevard": ["boulevard", "blvd", "boul", "bvd", "blv", "boulv"], "parkway": ["parkway", "pkwy", "pky", "parkwy", "pkway"], "square": ["square", "sq"],
    "terrace": ["terrace", "ter", "terr"], "highway": ["highway", "hwy"], "circle": ["circle", "cir", "circ"], "way": ["way", "wy"], "alley": ["alley", "aly"],
    "plaza": ["plaza", "plz"], "turnpike": ["turnpike", "tpke"], "expressway": ["expressway", "expy"], "trail": ["trail", "trl"], "loop": ["loop"],
}
DIRECTIONS: dict[str, list[str]] = {
    "n": ["n", "no", "north", "nth"], "s": ["s", "so", "south", "sth"], "e": ["e", "east"], "w": ["w", "west"],
    "ne": ["ne", "northeast"], "nw": ["nw", "northwest"], "se": ["se", "southeast"], "sw": ["sw", "southwest"],
}
ORDINALS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th",
    "ninth": "9th", "tenth": "10th", "eleventh": "11th", "twelfth": "12th",
}
#: Towns that go by two names.
TOWNS = {"newyork": "manhattan", "newyorkcity": "manhattan", "nyc": "manhattan"}
#: Edits that a name may differ by, by its least length.
EDITS = {14: 4, 10: 3, 6: 1}

_KIND = {s: k for k, v in KINDS.items() for s in v}
_DIRECTION = {s: k for k, v in DIRECTIONS.items() for s in v}
PARTS = "struct<number:string,name:string,kind:string,direction:string,town:string,zip:string>"

_REMARK = [
    re.compile(r"\([^)]*\)?"),
    re.compile(r"@[^,]*"),
    re.compile(r"\s[-–—]\s[^,]*"),
    re.compile(r"\b(opp|opposite|nr|near|behind|beside|next to|across from|cnr|corner of|c/o)\b\.?[^,]*"),
    re.compile(r"\b(ground|upper|lower|main|top|first|second|third|fourth|\d+(st|nd|rd|th))\s+(floor|flr|fl|level)\b"),
    re.compile(r"\b(rear|basement|bsmt|mezzanine|lobby|upstairs|downstairs|storefront)\b"),
]
_UNIT = re.compile(r"#\s*[a-z0-9-]+|\b(suite|ste|unit|apt|apartment|room|rm)\b\.?\s*#?\s*[a-z0-9]{1,5}\b|\b(fl|floor|flr|bldg|building)\b\.?\s*#?\s*\d{1,3}[a-z]?\b|\b\d{1,3}(st|nd|rd|th)\s+(floor|flr)\b")
_STATE = re.compile(r"[,\s]+[a-z]{2}\b\.?[\s,]*(\d{5})(-?\d{4})?[\s,]*$|[,\s]+(ny|fl)\b\.?[\s,]*$|,\s*(\d{5})(-?\d{4})?[\s,]*$")


def _letters(s: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", (s or "").lower()) if c.isalnum())


def _ordinal(n: int) -> str:
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def parse_address(address: str | None, city: str | None = None, postal: str | None = None) -> dict:
    """The components of one address; those left out are None. Without a number or a name the address names no place."""
    town = _letters(city) or None
    zip5 = re.match(r"\s*(\d{5})", postal or "")
    zip5 = zip5.group(1) if zip5 else None
    none = dict.fromkeys(("number", "name", "kind", "direction"))
    if not isinstance(address, str):
        return none | {"town": TOWNS.get(town, town), "zip": zip5}
    s = "".join(c for c in unicodedata.normalize("NFKD", address.lower()) if not unicodedata.combining(c))
    s = re.sub(r"\s+", " ", s).strip(" ,;.")
    m = _STATE.search(s)
    if m:
        zip5 = zip5 or m.group(1) or m.group(4)
        s = s[: m.start()]
    for pattern in _REMARK:
        s = pattern.sub(" ", s)
    s = _UNIT.sub(" ", s)
    parts = [p.strip(" .;-") for p in s.split(",")]
    parts = [p for p in parts if p and not (town and _letters(p) == town)]
    main, rest, numbered, named = [], [], False, False
    for p in parts:
        digits, letters = bool(re.search(r"\d", p)), bool(re.search(r"[a-z]{2}", p))
        if (digits and not numbered) or (letters and not named):
            main.append(p)
            numbered, named = numbered or digits, named or letters
        else:
            rest.append(p)
    town = town or next((_letters(p) for p in rest if not re.search(r"\d", p)), None)
    text = re.sub(r"(?<![a-z0-9�])(\d+)(?=[a-z]{3})(?!(st|nd|rd|th)\b)", r"\1 ", " ".join(main))
    text = re.sub(r"(?<![a-z0-9�])(\d+)(?=(n|s|e|w|no|so|ne|nw|se|sw)\b)", r"\1 ", text)
    tokens = [t for t in re.split(r"[^a-z0-9�']+", text) if t]
    tokens = [t.replace("'", "") for t in tokens]
    tokens = [t for i, t in enumerate(tokens) if not (t in ("no", "nr", "number") and i + 1 < len(tokens) and tokens[i + 1].isdigit())]
    at = next((i for i, t in enumerate(tokens) if t.isdigit()), None)
    if at is not None and at > 0:  # written after the street
        at = max(i for i, t in enumerate(tokens) if t.isdigit())
    if at is None:
        return none | {"town": TOWNS.get(town, town), "zip": zip5}
    number = tokens.pop(at).lstrip("0") or "0"
    tail = _letters(city)
    while tail and len(tokens) > 2 and _letters("".join(tokens[-3:])).endswith(tail) and _letters(tokens[-1]) and tail.endswith(_letters(tokens[-1])):
        tail = tail[: -len(_letters(tokens[-1]))]
        tokens.pop()
    direction = kind = None
    if len(tokens) > 1 and tokens[-1] in _DIRECTION:
        direction = _DIRECTION[tokens.pop()]
    if len(tokens) > 1 and tokens[-1] in _KIND:
        kind = _KIND[tokens.pop()]
    if len(tokens) > 1 and direction is None and tokens[-1] in _DIRECTION:
        direction = _DIRECTION[tokens.pop()]
    if len(tokens) > 1 and direction is None and tokens[0] in _DIRECTION:
        direction = _DIRECTION[tokens.pop(0)]
    name = "".join(_ordinal(int(t)) if t.isdigit() else ORDINALS.get(t, t) for t in tokens)
    return {"number": number, "name": name or None, "kind": kind, "direction": direction, "town": TOWNS.get(town, town), "zip": zip5}


def _parse(address: pd.Series, city: pd.Series, postal: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_address(a, c if isinstance(c, str) else None, p if isinstance(p, str) else None) for a, c, p in zip(address, city, postal)],
                        columns=["number", "name", "kind", "direction", "town", "zip"])


def with_components(df: DataFrame, address: str, city: str, postal: str) -> DataFrame:
    """Adds the struct ``place``; one Arrow batch at a time, row by row independent."""
    return df.withColumn("place", F.pandas_udf(_parse, PARTS)(F.col(address).cast("string"), F.col(city).cast("string"), F.col(postal).cast("string")))


def address_classes(records: DataFrame, *, record: str, address: str, city: str, postal: str) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: records with equal components form a class, so that copies are compared once.

    ``members(record, class_id)`` holds the records that name a place; ``classes`` has one row a class with its
    components. The class id is a hash of the components.
    """
    p = checkpoint(with_components(records.select(F.col(record).alias("record"), address, city, postal), address, city, postal))  # parsed once
    parts = ["number", "name", "kind", "direction", "town", "zip"]
    named = p.where("place.number IS NOT NULL AND place.name IS NOT NULL").select("record", *[F.col(f"place.{x}").alias(x) for x in parts])
    cid = F.xxhash64(*[F.coalesce(F.col(x), F.lit("\x00")) for x in parts])
    members = named.withColumn("class_id", cid)
    return members.select("record", "class_id"), members.groupBy("class_id").agg(*[F.first(x).alias(x) for x in parts])


def _allowed(length: Column) -> Column:
    return reduce(lambda c, kv: c.when(length >= kv[0], kv[1]), list(EDITS.items())[1:], F.when(length >= max(EDITS), EDITS[max(EDITS)])).otherwise(0)


def same_name(a: Column, b: Column) -> Column:
    """Equal, or within the allowed edits (a swap of neighbours counts as two) when long enough; numbered streets must be equal."""
    allowed = _allowed(F.least(F.length(a), F.length(b)))
    lettered = ~a.rlike("^[0-9]") & ~b.rlike("^[0-9]")
    return (a == b) | (lettered & (F.levenshtein(a, b) <= allowed))


def _cut(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """``(start, size)`` of piece ``i`` of the ``edits + 1`` pieces of a name; the last ones are longer by a letter where needed."""
    least, short = F.floor(length / (edits + 1)).cast("int"), edits + 1 - F.pmod(length, edits + 1)
    return i * least + F.greatest(F.lit(0), i - short), least + F.when(i >= short, 1).otherwise(0)


def _key(number: Column, length: Column, i: Column, piece: Column) -> Column:
    return F.xxhash64(number, length, i, piece)


def _indexed(name: Column, number: Column) -> Column:
    """The set that indexes a name: its pieces, one more than the edits it allows, each with the number, the length and the place."""
    length, edits = F.length(name), F.when(name.rlike("^[0-9]"), 0).otherwise(_allowed(F.length(name)))

    def one(i: Column) -> Column:
        start, size = _cut(length, edits, i)
        return _key(number, length, i, F.substring(name, start + 1, size))

    return F.transform(F.sequence(F.lit(0), edits), one)


def _probes(name: Column, number: Column) -> Column:
    """The set that a name probes with: wherever a piece of an equal or shorter name within the allowed edits can stand in it.

    Of two names within k edits, one of the k + 1 pieces of the shorter one stands unbroken in the longer one, moved by
    no more than the edits before it and no more than those left for the letters after it (Pass-Join).
    """
    size, most = F.length(name), max(EDITS.values())

    def of_length(less: Column) -> Column:
        length = size - less
        edits = F.when(name.rlike("^[0-9]"), 0).otherwise(_allowed(length))

        def of_piece(i: Column) -> Column:
            start, n = _cut(length, edits, i)
            low = F.greatest(F.lit(0), start - i, start + less - (edits - i))
            high = F.least(size - n, start + i, start + less + (edits - i))
            at = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda p: _key(number, length, i, F.substring(name, p + 1, n)))

        return F.when((length > 0) & (less <= edits), F.flatten(F.transform(F.sequence(F.lit(0), edits), of_piece))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), of_length)))


def compatible(a: str, b: str) -> Column:
    """No contradiction between the components of two sides: kind, direction and town (by postal code where a town is missing)."""
    def agree(x: str) -> Column:
        return F.col(f"{a}.{x}").isNull() | F.col(f"{b}.{x}").isNull() | (F.col(f"{a}.{x}") == F.col(f"{b}.{x}"))

    towns = F.when(F.col(f"{a}.town").isNotNull() & F.col(f"{b}.town").isNotNull(), F.col(f"{a}.town") == F.col(f"{b}.town")).otherwise(agree("zip"))
    return agree("kind") & agree("direction") & towns


def class_pairs(classes: DataFrame) -> DataFrame:
    """``(class_a, class_b, containment)`` of classes that mean one place, ``class_a < class_b``.

    Set-containment join: a class is indexed by the pieces of its name, each with the street number, and every class
    probes with the set of pieces that an equal or shorter name may have within the allowed edits. Names within them
    share one by the pigeonhole principle, so every pair whose names agree is met; it is kept if it has no contradictory
    component. ``containment`` is the share of the shorter name's pieces that the longer one contains. Components
    travel with the pieces, so contradictions are dropped where pairs arise.
    """
    parts = F.struct("number", "name", "kind", "direction", "town", "zip")
    index = classes.select(F.col("class_id").alias("i_id"), parts.alias("i"), F.explode(_indexed(F.col("name"), F.col("number"))).alias("piece"))
    probe = classes.select(F.col("class_id").alias("q_id"), parts.alias("q"), F.explode(_probes(F.col("name"), F.col("number"))).alias("piece"))
    met = index.join(probe, "piece").where((F.col("i_id") != F.col("q_id")) & (F.col("i.number") == F.col("q.number"))).where(compatible("i", "q")).where(same_name(F.col("i.name"), F.col("q.name")))
    pieces = F.size(_indexed(F.first("i.name"), F.first("i.number")))
    held = met.groupBy("i_id", "q_id").agg((F.count("*") / pieces).alias("containment"))
    return held.groupBy(F.least("i_id", "q_id").alias("class_a"), F.greatest("i_id", "q_id").alias("class_b")).agg(F.max("containment").alias("containment"))


def same_place_pairs(records: DataFrame, *, record: str, address: str, city: str, postal: str) -> DataFrame:
    """``(a, b)`` with ``a < b``: all pairs of records that mean one place. NULL, blank or numberless addresses pair with nothing."""
    members, classes = address_classes(records, record=record, address=address, city=city, postal=postal)
    links = class_pairs(classes).select("class_a", "class_b").unionByName(classes.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")))
    one = members.select(F.col("record").alias("x"), F.col("class_id").alias("class_a"))
    two = members.select(F.col("record").alias("y"), F.col("class_id").alias("class_b"))
    pairs = links.join(one, "class_a").join(two, "class_b")
    inside = F.col("class_a") == F.col("class_b")
    return pairs.where((~inside & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
