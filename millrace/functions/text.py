"""Text expressions: normalising, cleaning, counting, markers, bands."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Misspelled and corrected words of the domain's queries (entries that map to themselves change nothing).
TYPO_CORRECTIONS = {
    "sigota": "sigorta",
    "sigortaa": "sigorta",
    "sigrota": "sigorta",
    "ameliyet": "ameliyat",
    "hastahane": "hastane",
    "hastaane": "hastane",
    "hastene": "hastane",
    "dokotor": "doktor",
    "doktar": "doktor",
    "recete": "reçete",
    "recte": "reçete",
    "ilac": "ilaç",
    "ilaci": "ilacı",
    "muayne": "muayene",
    "muayane": "muayene",
    "muayna": "muayene",
    "labaratuvar": "laboratuvar",
    "labratuvar": "laboratuvar",
    "labartuar": "laboratuvar",
    "radyaloji": "radyoloji",
    "rontgen": "röntgen",
    "tomago": "tomografi",
    "tomagrofi": "tomografi",
    "endoskapi": "endoskopi",
    "ultrasan": "ultrason",
    "operasyan": "operasyon",
    "ameliyyat": "ameliyat",
    "hastalik": "hastalık",
    "tedavı": "tedavi",
    "tedavii": "tedavi",
    "saglik": "sağlık",
    "saglık": "sağlık",
    "saglk": "sağlık",
    "raporu": "raporu",
    "hekim": "hekim",
    "hekm": "hekim",
    "poliklinik": "poliklinik",
    "poliklink": "poliklinik",
    "acıl": "acil",
    "yogunbakim": "yoğun bakım",
    "yogun bakim": "yoğun bakım",
    "katılım": "katılım",
    "katilim": "katılım",
    "katilm": "katılım",
    "kapsam": "kapsam",
    "kapsamı": "kapsamı",
    "prim": "prim",
    "primm": "prim",
}

# Patterns of amendment notes, footnote references and heading notes in regulations.
AMENDMENT_NOTE = r"\((?:Değişik|Değişik ibare|Ek|Ek ibare|Mülga|Mülga ibare)[^)]+\)(?U)\s*(?-U)(?:\([0-9]+\))?"
FOOTNOTE_REF = r"\((?<!\n\()[0-9]{2,3}\)"
REPEAL_NOTE = r"\((?:Mülga)[^)]+\)(?U)\s*(?-U)(?:\([0-9]+\))?"
TITLE_NOTES = [r"(?d)\(Değişik:.*?\)", r"(?d)\(Ek:.*?\)", r"(?d)\(Mülga:.*?\)", r"\([0-9]+\)"]

# Fixed value: Unicode white space, what (?U)\s matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Fixed value: the note put before a question whose sources are weak.
HEDGE = (
    "[NOT: Belge desteği zayıf. Eğer cevap kaynaklarda yoksa kesin bilgi vermek yerine doğrulanması gerektiğini söyle "
    "ve SGK ALO 170'ten teyit edilmesini öner.]\n"
)


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    """The white-space separated words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fix_typos(text: Column, corrections: dict[str, str] | None = None) -> Column:
    """Replace each word whose lower-case form is listed. The dictionary is a bounded literal map."""
    entries = (corrections or TYPO_CORRECTIONS).items()
    table = F.create_map(*[F.lit(x) for pair in entries for x in pair])
    return F.array_join(F.transform(words(text), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")


def fix_typos_by_table(rows: DataFrame, corrections: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """:func:`fix_typos` with a dictionary too large for a literal: ``corrections(wrong, right)``, ``wrong`` in lower case.

    Words meet the dictionary in a join; only corrected ones go back to their row, by ``keys`` (distinct for each row) and
    place. Of several corrections of a word the smallest holds. A null text stays null.
    """
    known = corrections.groupBy("wrong").agg(F.min("right").alias("right"))
    placed = rows.select(*keys, F.posexplode(words(F.col(text))).alias("_place", "_word")).withColumn("wrong", F.lower("_word"))
    found = placed.join(known, "wrong").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_place", "right"))).alias("_right"))
    fixed = F.transform(words(F.col(text)), lambda w, i: F.coalesce(F.try_element_at(F.col("_right"), i), w))
    return rows.join(found, keys, "left").withColumn(text, F.array_join(fixed, " ")).drop("_right")


def preprocess(text: Column) -> Column:
    return fix_typos(normalize_whitespace(text))


def clean_text(text: Column) -> Column:
    """White space collapsed; only letters, digits, underscore and basic punctuation kept."""
    spaced = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(spaced, r"""(?U)[^\w\s.,!?;:()\-–—"']""", ""))


def clean_amendments(text: Column) -> Column:
    """Without amendment notes, and footnote references that do not start a line; double blanks collapsed."""
    out = F.regexp_replace(text, AMENDMENT_NOTE, "")
    out = F.regexp_replace(out, FOOTNOTE_REF, "")
    return strip(F.regexp_replace(out, "  +", " "))


def clean_title(title: Column) -> Column:
    out = strip(title)
    for note in TITLE_NOTES:
        out = strip(F.regexp_replace(out, note, ""))
    return out


def is_repealed(content: Column) -> Column:
    """Fewer than five words besides a repeal note."""
    rest = F.when(F.contains(content, F.lit("(Mülga")), F.regexp_replace(content, REPEAL_NOTE, "")).otherwise(content)
    return ~F.coalesce(rest.rlike(r"(?U)^\s*+(?:\S++\s++){4}\S"), F.lit(False))


def apply_hedge(question: Column, is_low: Column, note: str = HEDGE) -> Column:
    return F.when(is_low, F.concat(F.lit(note), question)).otherwise(question)


def truncate_preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def citation_markers(answer: Column) -> Column:
    """All numbers that stand in brackets, in order of appearance."""
    found = F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1))
    return F.transform(found, lambda x: x.cast("long"))


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 4.5, "good").when(score >= 3.5, "fair").otherwise("poor")


def relevance_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "none").when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0.1, "low").otherwise("weak")
    )


def relative_date_bucket(ts: Column, now: Column) -> Column:
    """Today, yesterday, n days, n weeks, or the date, by whole days between the two times."""
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000))
    return (
        F.when(days == 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days")))
        .when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def strip_fence(raw: Column) -> Column:
    """Without a surrounding Markdown code fence."""
    out = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", "")
    return F.regexp_replace(out, r"\s*```$", "")


def cache_key(text: Column, prefix: str = "answer:") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.lower(F.trim(text)).cast("binary"), 256), 1, 16))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
