"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Built from DataFrame functions only.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import before, let, part_of, sums_before, text_blocks


@dataclass(frozen=True)
class Kind:
    """How one kind of span is proposed, confirmed and scored.

    ``pattern`` is a Java pattern; ``needs`` a cheap pattern without which no text can hold a match; ``context`` the
    words that add ``near`` to the score when they occur in the ``WINDOW`` characters before the span. A confirmed
    span of a ``base`` kind always stays, one of another kind if its score reaches ``KEEP``.
    """

    name: str
    pattern: str
    needs: str
    score: float
    near: float
    context: str
    base: bool = True


WINDOW = 40
KEEP = 0.5
# The patterns find the leftmost longest runs without going back over a run that failed, so that texts of any length
# and shape take linear time and no recursion: a run may start only where its characters start, or at the end of the
# match before (\G), and repetitions are possessive.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        0.8,
        0.1,
        "mail|contact|write|correo|courriel",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]", 0.6, 0.2, "ip|host|server|address|addr"),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
        "[0-9]{2}|[0-9][ -][0-9]",
        0.7,
        0.2,
        "card|visa|master|credit|karte|carte|tarjeta",
    ),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, 0.2, "phone|tel|call|mobile|fax|cell"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        0.7,
        0.2,
        "iban|account|konto|compte|cuenta|bank",
        base=False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "[0-9]{3}-[0-9]{2}-",
        0.3,
        0.4,
        "ssn|social|security",
        base=False,
    ),
)


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97_valid(value: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97 with its head moved to the end."""
    moved = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda c: F.ascii(c))
    numbers = F.transform(codes, lambda c: F.when(c >= 65, c - 55).otherwise(c - 48))
    rest = F.aggregate(numbers, F.lit(0), lambda a, n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97)
    return rest == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.split(value, "\\.")
        # Leading zeros do not count towards the size of a part.
        short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn_valid(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97_valid(F.regexp_replace(value, " ", ""))
    return F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind in order of place, as array<struct<kind,start,end,score,value>>.

    A match starts behind the pieces and matches before it: the text split by the pattern has the pieces between.
    """
    pieces, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def confirmed(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: F.length(F.get(x["p"], i)) + F.length(m))
        spans = F.transform(
            sums_before(steps),
            lambda gone, i: F.struct(
                (gone + F.length(F.get(x["p"], i))).alias("start"),
                (gone + F.length(F.get(x["p"], i)) + F.length(F.get(x["m"], i))).alias("end"),
                F.get(x["m"], i).alias("value"),
            ),
        )
        return F.filter(spans, lambda s: _confirmed(kind.name, s["value"]))

    def scored(s: Column, blocks: Column) -> Column:
        low = F.greatest(s["start"] - WINDOW, F.lit(0))
        near = F.lower(part_of(blocks, low, s["start"] - low)).rlike(kind.context)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.round(F.lit(kind.score) + F.when(near, kind.near).otherwise(0.0), 3).alias("score"),
            s["value"].alias("value"),
        )

    found = let(F.struct(pieces.alias("p"), matches.alias("m")), confirmed)
    found = let(found, lambda f: F.when(F.size(f) > 0, let(text_blocks(text), lambda b: F.transform(f, lambda s: scored(s, b)))))
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= KEEP)
    return F.when(text.rlike(kind.needs), found)


def find_personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Add ``spans`` to every row: array<struct<kind, start, end, score, value>>, by kind as in ``KINDS``, then start.

    Offsets count code points, the end is exclusive. Spans of one kind do not overlap; spans of different kinds may.
    Null and empty texts have an empty array. All input columns stay; one named like ``out_col`` is replaced. One
    projection without shuffle, Python or aggregation: rows of any number, and texts of any length, one at a time.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kinds = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"
    none = F.from_json(F.lit("[]"), kinds)
    return docs.withColumn(out_col, F.concat(*[F.coalesce(_spans(text, kind), none) for kind in KINDS]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every span of personal data in the text column by its kind in brackets; other columns stay.

    Of overlapping spans the first stands for all. Texts without spans, null included, stay as they are.
    """
    name = "__personal_data"
    found = find_personal_data(docs, text_col, name)
    text = F.col(f"`{text_col}`")
    ordered = F.array_sort(F.transform(F.col(name), lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def cut(spans: Column, blocks: Column) -> Column:
        done = before(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

        def parts(s: Column, gone: Column) -> Column:
            mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] >= gone, F.concat(part_of(blocks, gone, s["start"] - gone), mark)).otherwise("")

        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        rest = part_of(blocks, end, F.length(text) - end)
        return F.concat(F.array_join(F.zip_with(spans, done, parts), ""), rest)

    redacted = let(ordered, lambda spans: let(text_blocks(text), lambda blocks: cut(spans, blocks)))
    changed = F.when(F.size(name) > 0, redacted).otherwise(text)
    return found.withColumn(text_col, changed).drop(name)


def with_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` from the output of :func:`find_personal_data`."""
    names = [k.name for k in KINDS if k.base]

    def written(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind))

    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return found.select(
        F.col(id_col),
        *[number(k).cast("long").alias(f"n_{k}") for k in names],
        F.sha2(F.array_join(F.transform(base, written), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
    )
