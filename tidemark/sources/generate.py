"""Generated person rows and injected delivery anomalies, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import chance

# Word lists for made-up people.
FIRST_NAMES = (
    "Ada Ben Cora Dan Ella Finn Gia Hugo Iris Jon Kira Liam Mona Nils Olga Paul "
    "Rosa Sven Tara Umar"
).split()
LAST_NAMES = (
    "Abel Brandt Castro Duval Eriksen Fischer Garcia Hughes Ivanov Jensen Keller "
    "Lopez Moreau Novak Olsen Petrov Quinn Rossi Silva Tanaka"
).split()
STREETS = "Oak Elm Mill Lake Hill Park Church River Station Market".split()
CITIES = "Seoul Busan Oslo Lyon Porto Graz Turin Leeds Ghent Malmo Bern Cork".split()
COMPANY_KINDS = "Ltd Inc Group Partners".split()

PERSON_FIELDS = ["id", "name", "address", "ip", "birth", "company", "phone"]


def _digits(hexed: Column, slot: int) -> Column:
    """Slot 0..7 of a 32-digit hash as a number below 65536."""
    return F.conv(F.substring(hexed, 4 * slot + 1, 4), 16, 10).cast("int")


def _pick(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), number % len(words) + 1)


def with_person(df: DataFrame, id_col: str, seed: int = 0, at: Column | None = None) -> DataFrame:
    """Person fields for every row; the same seed and id always give the same person.

    ``at`` adds an epoch-millisecond registration time ``regts``.
    """
    hexed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    d = [_digits(F.col("__hex"), slot) for slot in range(8)]
    last = _pick(LAST_NAMES, d[1])
    fields = {
        "name": F.concat_ws(" ", _pick(FIRST_NAMES, d[0]), last),
        "address": F.concat(
            (d[2] % 999 + 1).cast("string"), F.lit(" "), _pick(STREETS, d[3]),
            F.lit(" Street, "), _pick(CITIES, d[4]),
        ),
        # first number 11..99: public ranges only
        "ip": F.concat_ws(".", *[c.cast("string") for c in (
            d[5] % 89 + 11, d[6] % 256, F.floor(d[6] / 256), d[7] % 254 + 1)]),
        "birth": F.date_add(F.lit("1950-01-01").cast("date"), d[7] % 20000).cast("string"),
        "company": F.concat_ws(" ", last, _pick(COMPANY_KINDS, d[2])),
        "phone": F.concat_ws("-", F.lit("010"), F.lpad(d[5].cast("string"), 5, "0"),
                             F.lpad(d[6].cast("string"), 5, "0")),
    }
    people = df.withColumn("__hex", hexed).withColumns(fields).drop("__hex")
    return people if at is None else people.withColumn("regts", F.unix_millis(at))


def writer_slots(df: DataFrame, row: str, writers: int, batch: int) -> DataFrame:
    """Spread dense row numbers over writers: ``pid``, its sequence ``sid`` and ``epoch``."""
    pid, sid = F.col(row) % writers, F.floor(F.col(row) / writers)
    return df.withColumns({"pid": pid.cast("int"), "sid": sid.cast("bigint"),
                           "epoch": F.floor(sid / batch).cast("bigint")})


def inject_anomalies(
    rows: DataFrame,
    identity: str,
    ts: str,
    dup_rate: float = 0.0,
    lag_rate: float = 0.0,
    dup_delay: str = "3 seconds",
    lag_delay: str = "60 seconds",
    seed: int = 0,
) -> DataFrame:
    """Deliveries of ``rows``: some repeated after a delay, some held back.

    Adds ``emit_ts`` and ``delivery`` ("normal", "duplicate" or "late").  A row
    chosen for repetition is not held back.  Every row is delivered in the end.
    """
    dup = chance(f"dup{seed}", dup_rate, F.col(identity))
    lag = ~dup & chance(f"lag{seed}", lag_rate, F.col(identity))
    once = F.struct(F.col(ts).alias("emit_ts"), F.lit("normal").alias("delivery"))
    again = F.struct((F.col(ts) + F.expr(f"interval {dup_delay}")).alias("emit_ts"),
                     F.lit("duplicate").alias("delivery"))
    held = F.struct((F.col(ts) + F.expr(f"interval {lag_delay}")).alias("emit_ts"),
                    F.lit("late").alias("delivery"))
    sends = F.when(dup, F.array(once, again)).when(lag, F.array(held)).otherwise(F.array(once))
    return rows.withColumn("__send", F.explode(sends)).select(*rows.columns, "__send.*")
