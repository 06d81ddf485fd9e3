"""Chunking: word windows, sentence groups, and structure-aware chunks of numbered regulations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import chain, falling_powers, first_from, furthest, greedy_starts, let, sums_before
from millrace.functions.text import clean_amendments, clean_text, clean_title, is_repealed, strip, word_count, words

# Heading, chapter, paragraph and annex patterns of numbered regulations.
HEADING = r"(?m)(?d)^\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?(?:\.[A-ZÇĞİÖŞÜ])?(?:-[0-9]+)?)\s*[-–]?\s*(.+?)$"
ORDINAL = r"(?iu)(BİRİNCİ|İKİNCİ|ÜÇÜNCÜ|DÖRDÜNCÜ|BEŞİNCİ|ALTINCI|YEDİNCİ|SEKİZİNCİ|DOKUZUNCU|ONUNCU)"
CHAPTER = ORDINAL + r"\s+BÖLÜM"
PARAGRAPH = r"(?m)(?=^\s*\([0-9]+\)\s)"
PARAGRAPH_NUMBER = r"^\s*\(([0-9]+)\)\s"
ANNEX = r"(?iu)EK[-\s]*([0-9]+(?:/[A-ZÇĞİÖŞÜ])?(?:-[0-9]+)?)"
LETTER_ITEM = r"(?m)^\s*([a-zçğıöşü])\)\s+"
SENTENCE_END = r"(?<=[.!?])\s+"


def window_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, clean: bool = True) -> DataFrame:
    """Word windows of ``size`` with ``overlap``, up to the first that reaches the end of the text."""
    step = size - overlap
    text = clean_text(F.col("text")) if clean else F.col("text")
    rows = docs.select("doc_id", words(text).alias("w"))
    n = F.size("w")
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), (count - 1) * step, F.lit(step)))
    pieces = F.transform(starts, lambda s: F.slice(F.col("w"), s + 1, F.lit(size)))
    out = rows.select("doc_id", F.posexplode(pieces).alias("chunk_order", "piece"))
    return out.select(
        "doc_id",
        F.col("chunk_order").cast("long").alias("chunk_order"),
        F.array_join("piece", " ").alias("chunk_text"),
        F.size("piece").cast("long").alias("word_count"),
    )


def sentence_group_chunks(docs: DataFrame, size: int = 5) -> DataFrame:
    """Groups of ``size`` sentences (split at runs of ``.!?``, trimmed, empty ones dropped) joined by a full stop."""
    sentences = F.filter(F.transform(F.split("text", "[.!?]+"), strip), lambda s: s != "")
    rows = docs.select("doc_id", sentences.alias("s")).where(F.size("s") > 0)
    starts = F.sequence(F.lit(1), F.size("s"), F.lit(size))
    groups = F.transform(starts, lambda i: F.array_join(F.slice(F.col("s"), i, F.lit(size)), ". "))
    return rows.select("doc_id", F.posexplode(groups).alias("chunk_order", "chunk_text")).select(
        "doc_id", F.col("chunk_order").cast("long").alias("chunk_order"), "chunk_text"
    )


def sub_chunks(chunks: DataFrame, size: int = 120, overlap: int = 30, least: int = 20) -> DataFrame:
    """Add ``sub_order`` and ``sub_text``: texts of up to ``size`` words as they are, else windows of ``least`` or more words.

    The windows do not stop at the first that reaches the end: a tail inside its predecessor can appear.
    """
    step = size - overlap
    w = words(F.col("chunk_text"))
    rows = chunks.withColumn("_w", w)
    n = F.size("_w")
    starts = F.sequence(F.lit(0), F.floor((n - least) / step).cast("int") * step, F.lit(step))
    many = F.transform(starts, lambda s: F.array_join(F.slice(F.col("_w"), s + 1, F.lit(size)), " "))
    pieces = F.when(n <= size, F.array(F.col("chunk_text"))).otherwise(many)
    out = rows.select(*chunks.columns, F.posexplode(pieces).alias("sub_order", "sub_text"))
    return out.withColumn("sub_order", F.col("sub_order").cast("long"))


def pack_greedy(parts: Column, size_of, budget: Column, joiner: str) -> Column:
    """Ordered greedy packing of an array of strings: a group closes when the next part would exceed the budget.

    A part over the budget stays whole. Returns an array of joined groups. Where groups begin is found from the sizes
    alone; the texts of a group are joined once.
    """

    def join(x: Column) -> Column:
        last = F.size(x["parts"])
        return F.transform(
            x["starts"],
            lambda s, g: F.array_join(F.slice(x["parts"], s + 1, F.coalesce(F.get(x["starts"], g + 1), last) - s), joiner),
        )

    def grouped(p: Column) -> Column:
        sizes = F.transform(p, lambda t: size_of(t).cast("int"))
        return let(F.struct(p.alias("parts"), greedy_starts(sizes, budget.cast("int")).alias("starts")), join)

    return let(parts, lambda p: F.when(p.isNotNull(), grouped(p)))


def pack_sentences(docs: DataFrame, most: int = 350) -> DataFrame:
    """Greedy packing of sentences to at most ``most`` words; a longer sentence stays whole."""
    rows = docs.select("doc_id", F.split("text", SENTENCE_END).alias("s"))
    packed = pack_greedy(F.col("s"), word_count, F.lit(most), " ")
    out = rows.select("doc_id", F.posexplode(packed).alias("chunk_order", "chunk_text"))
    return out.select(
        "doc_id", F.col("chunk_order").cast("long").alias("chunk_order"), "chunk_text", word_count(F.col("chunk_text")).alias("word_count")
    )


def char_budget_chunks(docs: DataFrame, most: int = 3000) -> DataFrame:
    """Greedy packing of sentences by characters; the blank behind a full stop is consumed."""
    rows = docs.select("doc_id", F.split(F.replace(F.col("text"), F.lit(". "), F.lit(".|")), r"\|").alias("s"))
    packed = pack_greedy(F.col("s"), F.length, F.lit(most), "")
    return rows.select("doc_id", F.posexplode(packed).alias("chunk_order", "chunk_text")).select(
        "doc_id", F.col("chunk_order").cast("long").alias("chunk_order"), "chunk_text"
    )


def section_level(number: Column) -> Column:
    """2 for a.b, 3 for a.b.c, 4 for a.b.c.A, 5 for a.b.c.A-n, else 0."""
    letter = "[A-ZÇĞİÖŞÜ]"
    return (
        F.when(number.rlike(rf"^[0-9]+\.[0-9]+\.[0-9]+\.{letter}-[0-9]+$"), 5)
        .when(number.rlike(rf"^[0-9]+\.[0-9]+\.[0-9]+\.{letter}$"), 4)
        .when(number.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), 3)
        .when(number.rlike(r"^[0-9]+\.[0-9]+$"), 2)
        .otherwise(0)
    )


def parent_chain(number: Column) -> Column:
    """The numbers above a section, outermost first; empty for level 2 and unknown forms."""
    level = section_level(number)
    two, three = r"^([0-9]+\.[0-9]+)\.", r"^([0-9]+\.[0-9]+\.[0-9]+)\."
    return F.array_compact(
        F.array(
            F.when(level >= 3, F.regexp_extract(number, two, 1)),
            F.when(level >= 4, F.regexp_extract(number, three, 1)),
            F.when(level == 5, F.regexp_replace(number, r"-[0-9]+$", "")),
        )
    )


def is_parent(number: Column, other: Column) -> Column:
    """Whether ``other`` continues ``number`` by a dot or a dash."""
    return F.coalesce(
        F.startswith(other, F.concat(number, F.lit("."))) | F.startswith(other, F.concat(number, F.lit("-"))), F.lit(False)
    )


def heading_parts(pieces: Column, heads: Column) -> Column:
    """``array<struct<z: struct<head, body>, start>>`` of a text's headings and the pieces between them.

    Positions come from the lengths of the pieces. A text without headings has an empty array, a null text null.
    """
    first = F.length(F.element_at(pieces, 1))
    zipped = F.arrays_zip(heads.alias("head"), F.slice(pieces, 2, F.size(heads)).alias("body"))
    sizes = F.transform(zipped, lambda x: F.length(x["head"]) + F.length(x["body"]))
    starts = F.transform(sums_before(sizes), lambda n: first + n)
    return F.arrays_zip(zipped.alias("z"), starts.alias("start"))


def section_fields(part: Column, index: Column, cleaned: bool) -> list[Column]:
    """Number, own title, content and start of a section that is one of :func:`heading_parts`."""
    head, body = part["z"]["head"], part["z"]["body"]
    content = strip(F.concat(head, body))
    return [
        index.cast("long").alias("index"),
        F.regexp_extract(head, HEADING, 1).alias("section_number"),
        clean_title(F.regexp_extract(head, HEADING, 2)).alias("own_title"),
        (clean_amendments(content) if cleaned else content).alias("content"),
        part["start"].cast("long").alias("char_start"),
    ]


def split_sections(docs: DataFrame, cleaned: bool = True) -> DataFrame:
    """``(doc_id, index, section_number, section_title, content, word_count, level, char_start)`` of numbered headings.

    A section runs from its heading to the next one. Of repeated numbers in a document the last heading gives the
    title. Text before the first heading belongs to no section; only documents with headings make rows.
    """
    pieces, heads = F.split("text", HEADING, -1), F.regexp_extract_all("text", F.lit(HEADING), F.lit(0))
    rows = docs.select("doc_id", pieces.alias("p"), heads.alias("h"))  # documents without headings explode to no rows
    rows = rows.select("doc_id", F.posexplode(heading_parts(F.col("p"), F.col("h"))).alias("index", "x"))
    rows = rows.select("doc_id", *section_fields(F.col("x"), F.col("index"), cleaned))
    rows = rows.repartition("doc_id")  # serves the window below and what later goes by document
    last = Window.partitionBy("doc_id", "section_number").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("section_title", F.last("own_title").over(last)).drop("own_title")
    return rows.withColumn("word_count", word_count(F.col("content"))).withColumn("level", section_level(F.col("section_number")).cast("long"))


def chapter_marks(text: Column) -> Column:
    """``array<struct<pos, chapter>>`` of a text's chapter headings, the matches of ``CHAPTER``.

    The text is cut once, before each run of blanks that "BÖLÜM" follows; pieces that end with an ordinal are before a
    chapter's name. No ordinal ends with another or has a letter of the end of "BÖLÜM" in front, so no two matches overlap.
    """

    def marks(p: Column) -> Column:
        def mark(end: Column, i: Column) -> Column:
            ordinal = F.regexp_extract(F.substring(F.get(p, i), -9, 9), ORDINAL + r"\z", 1)  # the longest has nine letters
            name = F.regexp_extract(F.get(p, i + 1), r"(?iu)\A\s+BÖLÜM", 0)
            return F.struct((end - F.length(ordinal)).cast("long").alias("pos"), F.concat(ordinal, name).alias("chapter"), ordinal.alias("ordinal"))

        ends = F.slice(sums_before(F.transform(p, F.length)), 2, F.size(p) - 1)  # of all pieces but the last
        found = F.filter(F.transform(ends, mark), lambda x: x["ordinal"] != "")
        return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["chapter"].alias("chapter")))

    return let(F.split(text, r"(?iu)(?=\s)(?<!\s)(?=\s+BÖLÜM)", -1), marks)


def chapters(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, chapter)`` of every chapter heading."""
    rows = docs.select("doc_id", F.explode(chapter_marks(F.col("text"))).alias("x"))
    return rows.select("doc_id", "x.pos", "x.chapter")


def chapter_as_of(sections: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``chapter``: the latest chapter heading at or before a section's start (null before the first)."""
    both = sections.withColumn("_pos", F.col("char_start")).withColumn("chapter", F.lit(None).cast("string")).withColumn("_section", F.lit(1))
    marks = found.select("doc_id", F.col("pos").alias("_pos"), "chapter").withColumn("_section", F.lit(0))
    rows = both.unionByName(marks, allowMissingColumns=True)
    latest = Window.partitionBy("doc_id").orderBy("_pos", "_section").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chapter", F.last("chapter", ignorenulls=True).over(latest))
    return rows.where("_section = 1").drop("_pos", "_section")


def merged_groups(sections: Column, most: int, threshold: int) -> Column:
    """``array<struct<first, n>>``: the groups that small neighbouring sections of a document form, by place and number.

    ``sections`` are structs in order with ``section_number``, ``word_count`` and ``repealed``. Repealed sections and small
    ones that only head the next one are dropped and part groups. A section joins the open group if the group has under
    ``threshold`` words, or if the section has and both fit into ``most``. So a group that begins at i ends before the first
    dropped place, or before the first place from which on it has ``threshold`` words where a section is large or does not
    fit: places that sums of words and searches in them give, without a fold over the sections.
    """
    dropped = F.transform(
        sections,
        lambda x, i: x["repealed"] | (is_parent(x["section_number"], F.get(sections, i + 1)["section_number"]) & (x["word_count"] < threshold)),
    )
    sizes = F.transform(sections, lambda x: x["word_count"].cast("int"))
    n = F.size(sections)
    facts = F.struct(
        dropped.alias("dropped"),
        first_from(dropped, n).alias("gap"),
        first_from(F.transform(sizes, lambda w: w >= threshold), n).alias("large"),
        sums_before(F.concat(sizes, F.array(F.lit(0)))).alias("sums"),
        falling_powers(n + 1).alias("powers"),
    )

    def following(x: Column) -> Column:
        def end(i: Column) -> Column:
            words = F.get(x["sums"], i)
            filled = F.least(n, furthest(x["sums"], i, words + (threshold - 1), x["powers"]) + 1)
            over = F.greatest(filled, furthest(x["sums"], i, words + most, x["powers"]))
            stop = F.least(F.get(x["gap"], i + 1), F.get(x["large"], filled), over)
            return F.when(F.get(x["dropped"], i), i + 1).otherwise(stop)

        return F.transform(x["dropped"], lambda _, i: end(i))

    def groups(x: Column) -> Column:
        def cut(f: Column) -> Column:
            starts = F.filter(chain(f), lambda p: ~F.get(x["dropped"], p))
            return F.transform(starts, lambda p: F.struct(p.alias("first"), (F.get(f, p) - p).alias("n")))

        return let(following(x), cut)

    return let(facts, groups)


SECTION = ["index", "section_number", "section_title", "content", "word_count", "level", "char_start"]


def merged_sections(sections: Column, most: int, threshold: int) -> Column:
    """The sections that :func:`merged_groups` forms of a document's, with ``is_merged`` and ``merged_sections``.

    A group takes the number, title, level and start of its first member and joins the contents by a blank line; texts
    are joined once for each group.
    """

    def joined(s: Column) -> Column:
        def one(m: Column) -> Column:
            first, merged = F.get(m["members"], F.lit(0)), F.size(m["members"]) > 1
            count = F.aggregate(m["members"]["word_count"], F.lit(0).cast("long"), lambda a, n: a + n)  # blank lines part words
            numbers = F.when(merged, m["members"]["section_number"]).otherwise(F.array().cast("array<string>"))
            fields = {c: first[c] for c in SECTION} | {"content": m["text"], "word_count": count, "is_merged": merged, "merged_sections": numbers}
            return F.struct(*[v.alias(c) for c, v in fields.items()])

        def members(g: Column) -> Column:
            m = F.slice(s, g["first"] + 1, g["n"])
            return F.struct(m.alias("members"), F.array_join(m["content"], "\n\n").alias("text"))

        return F.transform(F.transform(merged_groups(s, most, threshold), members), one)

    return let(sections, joined)


def merge_small_sections(sections: DataFrame, most: int = 350, threshold: int = 75) -> DataFrame:
    """Sections with small neighbours joined, and empty headers and repealed ones gone; see :func:`merged_sections`.

    A document's sections meet in one row, as the document was before it was cut.
    """
    rows = sections.withColumn("repealed", is_repealed(F.col("content")))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*SECTION, "repealed"))).alias("s"))
    return rows.select("doc_id", F.explode(merged_sections(F.col("s"), most, threshold)).alias("x")).select("doc_id", "x.*")


def short_title(title: Column, most: int = 60) -> Column:
    return F.when(F.length(title) > most, F.concat(F.substring(title, 1, most), F.lit("..."))).otherwise(title)


def parent_line(number: Column, title: Column) -> Column:
    return F.concat(F.lit("["), number, F.lit(": "), short_title(title), F.lit("]"))


def header_lines(chapter: Column, above: Column, number: Column, title: Column) -> Column:
    """The chapter, the lines ``above`` of the parents (null for none) and the section itself, one line each."""
    own = F.concat(F.lit("[SECTION: "), number, F.lit(" - "), short_title(title), F.lit("]"))
    lines = F.when(F.size(above) > 0, F.array_join(above, "\n"))
    return F.concat_ws("\n", F.concat(F.lit("[BÖLÜM: "), chapter, F.lit("]")), lines, own)


def with_context_header(sections: DataFrame, titles: DataFrame, context: bool = True) -> DataFrame:
    """Add ``parent_chain`` and ``context_header``: chapter, titled parents and the section itself, one line each.

    ``titles(doc_id, section_number, section_title)`` are the headings of the same documents; each section meets its
    at most three parents by an equi-join.
    """
    rows = sections.withColumn("parent_chain", parent_chain(F.col("section_number")))
    if not context:
        return rows.withColumn("context_header", F.lit(""))
    known = titles.groupBy("doc_id", F.col("section_number").alias("_n")).agg(F.first("section_title").alias("_t"))
    pairs = rows.select("doc_id", "index", F.posexplode("parent_chain").alias("_i", "_n")).join(known, ["doc_id", "_n"])
    line = parent_line(F.col("_n"), F.col("_t"))
    above = pairs.groupBy("doc_id", "index").agg(F.sort_array(F.collect_list(F.struct("_i", line.alias("l")))).alias("_above"))
    rows = rows.join(above, ["doc_id", "index"], "left")
    header = header_lines(F.col("chapter"), F.col("_above.l"), F.col("section_number"), F.col("section_title"))
    return rows.withColumn("context_header", header).drop("_above")


def headed_units(
    texts: Column, doc_id: Column, most: int, threshold: int, merge_small: bool, include_context: bool, legacy_merged_chapter: bool
) -> Column:
    """A document's sections with chapter, ``parent_chain`` and ``context_header``, ready for :func:`chunk_sections`.

    The same as :func:`split_sections`, :func:`merge_small_sections`, :func:`chapter_as_of` and :func:`with_context_header` give,
    but from the ``texts`` of one ``doc_id`` (nearly always one), as an array of structs. What is looked up by number or by
    position is found by binary searches in sorted arrays.
    """

    def cut(text: Column) -> Column:
        both = F.struct(F.split(text, HEADING, -1).alias("p"), F.regexp_extract_all(text, F.lit(HEADING), F.lit(0)).alias("h"))
        return let(both, lambda x: F.transform(heading_parts(x["p"], x["h"]), lambda part, i: F.struct(*section_fields(part, i, True))))

    def found(text: Column) -> Column:
        return F.struct(cut(text).alias("sections"), chapter_marks(text).alias("marks"))

    def tables(x: Column) -> Column:
        """The sections, their numbers with the title of the last of each, and the chapters with one of no name before all."""
        titles = F.array_sort(F.transform(x["sections"], lambda s: F.struct(s["section_number"].alias("n"), s["index"], s["own_title"].alias("t"))))
        last = let(titles, lambda t: F.filter(t, lambda s, i: F.coalesce(F.get(t, i + 1)["n"] != s["n"], F.lit(True))))
        none = F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("chapter"))
        marks = F.concat(F.array(none), F.array_sort(x["marks"]))
        return F.struct(x["sections"].alias("sections"), searchable(last, "n").alias("titles"), searchable(marks, "pos").alias("marks"))

    def title(x: Column, number: Column) -> Column:
        """Null for a number that no section has."""
        at = latest(x["titles"], number)
        return let(at, lambda s: F.when(s["n"] == number, s["t"]))

    def titled(x: Column) -> Column:
        def section(s: Column) -> Column:
            fields = {c: s[c] for c in SECTION if c in ("index", "section_number", "content", "char_start")}
            fields |= {"section_title": title(x, s["section_number"]), "word_count": word_count(s["content"])}
            fields |= {"level": section_level(s["section_number"]).cast("long"), "repealed": is_repealed(s["content"])}
            return F.struct(*[fields[c].alias(c) for c in [*SECTION, "repealed"]])

        return F.array_sort(F.transform(x["sections"], section))

    def unmerged(sections: Column) -> Column:
        more = [F.lit(False).alias("is_merged"), F.array().cast("array<string>").alias("merged_sections")]
        return F.transform(sections, lambda s: F.struct(*[s[c].alias(c) for c in SECTION], *more))

    def units(x: Column) -> Column:
        """The units in order, each with its chapter, its parents and their lines."""
        joined = merged_sections(titled(x), most, threshold) if merge_small else unmerged(titled(x))

        def unit(u: Column) -> Column:
            start = F.when(u["is_merged"], F.lit(0).cast("long")).otherwise(u["char_start"]) if legacy_merged_chapter else u["char_start"]
            lines = F.transform(parent_chain(u["section_number"]), lambda n, i: F.struct(i.alias("i"), parent_line(n, title(x, n)).alias("l")))
            more = {"chapter": latest(x["marks"], start)["chapter"], "parent_chain": parent_chain(u["section_number"])}
            more |= {"lines": F.filter(lines, lambda e: e["l"].isNotNull())}
            return F.struct(*[u[c].alias(c) for c in [*SECTION, "is_merged", "merged_sections"]], *[v.alias(c) for c, v in more.items()])

        return F.transform(F.filter(joined, lambda u: ~is_repealed(u["content"])), unit)

    def lines_of(x: Column, u: Column) -> Column:
        """The lines of the parents of all units of a place; there are several where texts share an id."""
        first = F.when(F.get(x["keys"], F.lit(0)) >= u["index"], 0).otherwise(furthest(x["keys"], F.lit(0), u["index"] - 1, x["powers"]) + 1)
        end = furthest(x["keys"], F.lit(0), u["index"], x["powers"]) + 1
        return let(first, lambda f: F.array_sort(F.flatten(F.slice(x["rows"], f + 1, end - f)["lines"])))

    def with_headers(x: Column) -> Column:
        def one(u: Column) -> Column:
            above = F.when(x["nameless"], F.lit(None)).when(x["alone"], u["lines"]).otherwise(lines_of(x["units"], u))
            header = let(above, lambda a: header_lines(u["chapter"], a["l"], u["section_number"], u["section_title"])) if include_context else F.lit("")
            kept = [*SECTION, "is_merged", "merged_sections", "chapter", "parent_chain"]
            return F.struct(*[u[c].alias(c) for c in kept], header.alias("context_header"))

        return F.transform(x["units"]["rows"], one)

    by_text = F.transform(F.filter(texts, lambda t: t.isNotNull()), found)
    whole = let(by_text, lambda x: F.struct(F.flatten(x["sections"]).alias("sections"), F.flatten(x["marks"]).alias("marks")))
    table = searchable(let(let(whole, tables), units), "index")
    return let(F.struct(table.alias("units"), (F.size(texts) == 1).alias("alone"), doc_id.isNull().alias("nameless")), with_headers)


def searchable(rows: Column, key: str) -> Column:
    """An array of structs in ascending order of ``key``, as :func:`latest` takes it."""
    return let(rows, lambda r: F.struct(r.alias("rows"), r[key].alias("keys"), falling_powers(F.size(r)).alias("powers")))


def latest(table: Column, key: Column) -> Column:
    """The last row of a :func:`searchable` array whose key is at most ``key``, or its first."""
    return F.get(table["rows"], furthest(table["keys"], F.lit(0), key, table["powers"]))


def split_paragraphs(text: Column) -> Column:
    """Pieces that start with a numbered paragraph marker; text before the first marker is dropped."""
    pieces = F.transform(F.split(text, PARAGRAPH), strip)
    return F.filter(pieces, lambda p: p.rlike(PARAGRAPH_NUMBER))


def chunk_sections(sections: DataFrame, most: int = 350) -> DataFrame:
    """Chunks of sections with a context header: whole if it fits, else by paragraph, else by sentence.

    The budget is ``most`` less the header's words less 5. A paragraph that does not fit is split by sentence as well.
    """
    header_words = word_count(F.col("context_header"))
    rows = sections.withColumn("_budget", F.lit(most) - header_words - 5)
    fits = F.col("word_count") <= F.col("_budget")
    rows = rows.withColumn("_paras", F.when(fits, F.lit(None)).otherwise(split_paragraphs(F.col("content"))))
    whole = F.array(
        F.struct(
            F.col("content").alias("t"),
            F.lit(None).cast("string").alias("fikra"),
            F.when(F.col("is_merged"), "merged_section").otherwise("full_section").alias("chunk_type"),
            F.lit(0).cast("long").alias("chunk_index"),
        )
    )

    def sentences(text: Column, fikra: Column, budget: Column) -> Column:
        packed = pack_greedy(F.split(text, SENTENCE_END), word_count, budget, " ")
        return F.transform(
            packed,
            lambda t, i: F.struct(
                t.alias("t"), fikra.alias("fikra"), F.lit("sentence_split").alias("chunk_type"), i.cast("long").alias("chunk_index")
            ),
        )

    def paragraph(p: Column) -> Column:
        number = F.regexp_extract(p, PARAGRAPH_NUMBER, 1)
        budget = F.col("_budget") - 2  # the line "[FIKRA: (n)]" has two words
        one = F.array(
            F.struct(p.alias("t"), number.alias("fikra"), F.lit("fikra").alias("chunk_type"), F.lit(0).cast("long").alias("chunk_index"))
        )
        if_header = F.when(F.col("context_header") == "", F.col("_budget")).otherwise(budget)
        return F.when(word_count(p) <= if_header, one).otherwise(sentences(p, number, if_header))

    split = F.when(F.size("_paras") > 0, F.flatten(F.transform("_paras", paragraph))).otherwise(
        sentences(F.col("content"), F.lit(None).cast("string"), F.col("_budget"))
    )
    pieces = F.when(fits, whole).otherwise(split)
    rows = rows.select("*", F.posexplode(pieces).alias("part", "x"))
    single = F.col("x.chunk_type").isin("merged_section", "full_section")
    header = F.when(
        F.col("x.fikra").isNotNull() & (F.col("context_header") != ""),
        F.concat("context_header", F.lit("\n[FIKRA: ("), F.col("x.fikra"), F.lit(")]")),
    ).otherwise(F.col("context_header"))
    return rows.select(
        "doc_id",
        "index",
        F.col("part").cast("long").alias("part"),
        F.col("x.t").alias("chunk_text"),
        header.alias("context_header"),
        F.when(single, F.col("word_count")).otherwise(word_count(F.col("x.t"))).alias("word_count"),
        "section_number",
        "section_title",
        "level",
        "parent_chain",
        "chapter",
        F.col("x.fikra").alias("fikra"),
        F.col("x.chunk_type").alias("chunk_type"),
        F.col("x.chunk_index").alias("chunk_index"),
        (F.col("is_merged") & single).alias("is_merged"),
        F.when(single, F.col("merged_sections")).otherwise(F.array().cast("array<string>")).alias("merged_sections"),
    )


def finalize_chunks(chunks: DataFrame, least: int | None = None) -> DataFrame:
    """Drop chunks under ``least`` words, if given, and number the rest densely within each document."""
    kept = chunks if least is None else chunks.where(F.col("word_count") >= least)
    order = Window.partitionBy("doc_id").orderBy("index", "part")
    return kept.withColumn("chunk_order", (F.row_number().over(order) - 1).cast("long")).drop("index", "part")


def no_heading_fallback(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """One level-0 chunk titled "Document" for each document without headings."""
    return whole_documents(docs.join(sections.select("doc_id").distinct(), "doc_id", "left_anti"))


def whole_documents(docs: DataFrame) -> DataFrame:
    """Each document as one level-0 chunk titled "Document"."""
    return docs.select(
        "doc_id",
        F.lit(0).cast("long").alias("chunk_order"),
        F.col("text").alias("chunk_text"),
        F.lit("").alias("context_header"),
        word_count(F.col("text")).alias("word_count"),
        F.lit("").alias("section_number"),
        F.lit("Document").alias("section_title"),
        F.lit(0).cast("long").alias("level"),
    )


def structure_chunk_documents(
    docs: DataFrame,
    most: int = 350,
    threshold: int = 75,
    least: int = 100,
    preserve_all: bool = True,
    merge_small: bool = True,
    include_context: bool = True,
    legacy_merged_chapter: bool = False,
) -> DataFrame:
    """Structure-aware chunks of whole documents: sections, merging, context, splitting, order; fallback without headings.

    ``legacy_merged_chapter`` looks a merged section's chapter up at position 0 instead of at its own start. Texts are
    shuffled once, to meet those of equal ``doc_id`` in one row; all steps work in that row or keep its partition.
    """
    rows = docs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("text"))).alias("t"))
    rows = rows.select("doc_id", F.col("t.text").alias("texts"))
    units = headed_units(F.col("texts"), F.col("doc_id"), most, threshold, merge_small, include_context, legacy_merged_chapter)
    chunks = chunk_sections(rows.select("doc_id", F.explode(units).alias("x")).select("doc_id", "x.*"), most)
    done = finalize_chunks(chunks, None if preserve_all else least)
    headed = F.exists("texts", lambda t: F.coalesce(t.rlike(HEADING), F.lit(False)))
    bare = rows.where(F.col("doc_id").isNull() | ~headed)  # a null id equals none, so it has no sections to be found by
    return done.unionByName(whole_documents(bare.select("doc_id", F.explode("texts").alias("text"))), allowMissingColumns=True)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row: number, total, mean, least and most words, distinct sections, and counts by level and type."""
    totals = chunks.agg(
        F.count("*").alias("total_chunks"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
        F.round(F.avg("word_count"), 4).alias("avg_words"),
        F.min("word_count").alias("min_words"),
        F.max("word_count").alias("max_words"),
        F.countDistinct("section_number").alias("sections_covered"),
    )

    def counts(column: str) -> DataFrame:
        grouped = chunks.groupBy(column).agg(F.count("*").alias("n")).where(F.col(column).isNotNull())
        entry = F.concat_ws(":", F.col(column).cast("string"), F.col("n").cast("string"))
        return grouped.agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias(f"by_{column}"))

    one_row = F.lit(True)
    return totals.join(counts("level"), one_row).join(counts("chunk_type"), one_row)


def text_for_llm(header: Column, text: Column) -> Column:
    """The context header, a blank line and the text; the text alone without a header."""
    return F.when(F.coalesce(header, F.lit("")) == "", text).otherwise(F.concat(header, F.lit("\n\n"), text))


def annex_references(docs: DataFrame) -> DataFrame:
    """``(doc_id, annex, n)``: how often each document mentions each annex."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(ANNEX), F.lit(1))).alias("annex"))
    return found.groupBy("doc_id", "annex").agg(F.count("*").alias("n"))


def letter_items(docs: DataFrame) -> DataFrame:
    """``(doc_id, letter, n)``: lettered items at the start of lines."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTER_ITEM), F.lit(1))).alias("letter"))
    return found.groupBy("doc_id", "letter").agg(F.count("*").alias("n"))
