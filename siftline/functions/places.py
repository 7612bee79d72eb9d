"""Countries by name: a small fixed dimension, held as a map literal so that no join is needed."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import text, trim

# Names that the country file lacks, and location words that name no country.
ALIASES = {
    "uk": "GB",
    "u.k.": "GB",
    "great britain": "GB",
    "britain": "GB",
    "usa": "US",
    "u.s.a.": "US",
    "u.s.": "US",
    "united states": "US",
    "america": "US",
    "the netherlands": "NL",
    "holland": "NL",
    "czechia": "CZ",
    "czech republic": "CZ",
    "україна": "UA",
}
NOWHERE = ("remote", "worldwide", "anywhere", "global", "flexible", "hybrid")
# The listing territories in order, by their two- and three-letter codes.
TERRITORIES = (
    ("DEU", "DE"), ("NLD", "NL"), ("POL", "PL"), ("FRA", "FR"), ("ESP", "ES"), ("ITA", "IT"), ("IRL", "IE"), ("SWE", "SE"), ("BEL", "BE"), ("AUT", "AT"),
    ("CZE", "CZ"), ("PRT", "PT"), ("ROU", "RO"), ("GRC", "GR"), ("FIN", "FI"), ("DNK", "DK"), ("HUN", "HU"), ("GBR", "GB"), ("UKR", "UA"),
)
#: A country dimension is small; a larger table is a mistake.
MOST_COUNTRIES = 5_000


class Countries:
    """Resolves country names to two-letter codes (PRJ-14, PRJ-15)."""

    def __init__(self, names: dict[str, str]):
        known = {k.strip().lower(): v.upper() for k, v in names.items() if k.strip() and v} | ALIASES
        self._map = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in known.items() if k not in NOWHERE))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Countries:
        """From a JSON array of ``alpha_2`` and ``name`` (SRC-27)."""
        return cls.of(spark.read.schema("alpha_2 string, name string").option("multiLine", True).json(path))

    @classmethod
    def of(cls, table: DataFrame) -> Countries:
        rows = table.select("name", "alpha_2").limit(MOST_COUNTRIES + 1).collect()
        if len(rows) > MOST_COUNTRIES:
            raise ValueError(f"more than {MOST_COUNTRIES} countries")
        return cls({r["name"] or "": r["alpha_2"] or "" for r in rows})

    def code(self, name: Column) -> Column:
        """The code of one name, or an empty string."""
        return F.coalesce(F.element_at(self._map, F.lower(trim(name))), F.lit(""))

    def first(self, *locations: Column) -> Column:
        """Code of the first comma-separated part that names a country, over arrays of locations (PRJ-16 to PRJ-19)."""
        empty = F.array().cast("array<string>")
        parts = F.flatten(F.transform(F.concat(*[F.coalesce(x, empty) for x in locations]), lambda x: F.split(text(x), ",")))
        return F.coalesce(F.try_element_at(F.filter(F.transform(parts, self.code), lambda c: c != ""), F.lit(1)), F.lit(""))

    def code_or_name(self, raw: Column) -> Column:
        """Two letters are a code as they are, upper case; longer strings are names (PRJ-21)."""
        return F.when(F.octet_length(trim(raw)) == 2, F.upper(trim(raw))).otherwise(self.code(raw))


def territories(spark: SparkSession) -> DataFrame:
    """The listing territories with their order (SRC-20)."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TERRITORIES)], "ordinal int, alpha_3 string, alpha_2 string")
