"""Labels and flags of narratives by ordered patterns (T1, T2), all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories in order of priority. The patterns are a default lexicon of this library and a parameter.
CATEGORIES = ["fire_thermal", "electrical_failure", "loss_of_power", "engine_stall", "engine_failure", "airbag", "brakes", "steering", "seat_belt", "fuel_leak", "transmission", "lighting", "suspension", "structure_body", "tires_wheels", "other"]
WORD = "(?:^|[^a-z])"
LEXICON = {
    "fire_thermal": "fire|flame|smoke|smoking|burning|burned|melted|overheat",
    "electrical_failure": "electrical|wiring|battery|fuse|shorted|screen froze|gauge",
    "loss_of_power": "lost (?:all )?(?:motive )?power|loss of power|failed to accelerate|power assist|no power",
    "engine_stall": "stall|shut off|shut down|engine died|would not restart",
    "engine_failure": "engine (?:seized|block|knock|fail)|seized",
    "airbag": "air ?bag",
    "brakes": "brake|abs pump",
    "steering": "steering",
    "seat_belt": "seat ?belt|buckle|restraint",
    "fuel_leak": "fuel (?:leak|dripped|line|pump)|gas smell|gasoline",
    "transmission": "transmission|gear|clutch|shifting",
    "lighting": "headlight|headlamp|tail ?light|turn signal",
    "suspension": "suspension|control arm|shock|ball joint|axle",
    "structure_body": "hood|door|latch|floor pan|frame",
    "tires_wheels": "tire|wheel|rim",
}
FLAGS = ["smoke", "driving", "parked", "fire", "crash", "injured"]
FLAG_PATTERNS = {"smoke": "smoke|smoking", "driving": "driving|while moving|highway", "parked": "parked|parking|garage|driveway"}


def matches(text: Column, words: str) -> Column:
    """Whether one of the words begins somewhere in the text, after no other letter, in any case."""
    return F.lower(text).rlike(WORD + "(?:" + words + ")")


def assigned(text: Column, lexicon: dict[str, str] = LEXICON) -> Column:
    """All categories of a text, in order of priority; null and empty texts have none."""
    return F.array_compact(F.array(*[F.when(matches(text, w), F.lit(c)) for c, w in lexicon.items()]))


def keyword_labels(df: DataFrame, text: str = "text", lexicon: dict[str, str] = LEXICON) -> DataFrame:
    """df with primary (the first category, or other) and secondary (at most the two next)."""
    found = df.withColumn("_found", assigned(F.col(text), lexicon))
    return found.withColumn("primary", F.coalesce(F.get("_found", F.lit(0)), F.lit("other"))).withColumn("secondary", F.slice("_found", 2, 2)).drop("_found")


def flags(text: Column, fire: Column, crash: Column, injured: Column) -> Column:
    """The flags of a record, in fixed order; missing values count as not set."""
    tests = [matches(text, FLAG_PATTERNS[f]) for f in FLAGS[:3]] + [fire, crash, injured > 0]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(f)) for f, t in zip(FLAGS, tests)]))
