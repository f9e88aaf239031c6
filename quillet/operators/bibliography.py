"""Bibliography: entries to formatted, deduplicated, numbered citations. Expressions and grouped aggregations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import once

MONTHS = "jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december".split()  # fixed values
ET_AL = r"(?i)^et[~\s]+al\b\.?$"
BIBITEM = r"\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}"


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))


def plain(t: Column) -> Column:
    """Text of a field without braces, emphasis commands and backslashes; dashes as en dashes. Most fields have nothing of the
    kind, which one look tells."""
    t = F.coalesce(t, F.lit(""))
    marked = squeeze(F.regexp_replace(t, r"[{}]", ""))
    marked = F.regexp_replace(F.regexp_replace(marked, r"\\&", "&"), "---|--", "–")
    marked = squeeze(F.regexp_replace(F.regexp_replace(marked, r"\\(textit|emph|textbf)\s*", ""), r"\\", ""))
    return F.when(t.rlike(r"[{}\\\t\n\x0b\f\r]|--|  "), marked).otherwise(F.trim(t))


def url_in(t: Column) -> Column:
    """The address of a url command, else the first bare one without closing punctuation, else an empty string."""
    t = F.coalesce(t, F.lit(""))
    command = F.trim(F.regexp_extract(t, r"\\url\{([^}]+)\}", 1))
    bare = F.regexp_replace(F.regexp_extract(t, r"(https?://\S+)", 1), r"[.,;)}\]]+$", "")
    return F.when(command != "", command).otherwise(bare)


def brace_months(t: Column) -> Column:
    """Bare month names in braces, which strict parsers want."""
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    return F.regexp_replace(t, rf"(?i)(\bmonth\s*=\s*)({names})(\s*,)", r"$1{$2}$3")


def field(fields: Column, *names: str) -> Column:
    """The first field that is not empty, as plain text."""
    return F.coalesce(*(F.when(F.coalesce(F.try_element_at(fields, F.lit(n)), F.lit("")) != "", plain(F.try_element_at(fields, F.lit(n)))) for n in names), F.lit(""))


def year_of(fields: Column) -> Column:
    y = field(fields, "year", "date")
    return F.when(y.rlike(r"^\d{4}-"), F.substring(y, 1, 4)).otherwise(y)


def people(t: Column) -> Column:
    """struct(names, more): names as "Last First", and whether there are others that are not named."""
    return once(
        F.filter(F.transform(F.split(t, " and "), squeeze), lambda a: a != ""),
        lambda every: F.struct(
            F.transform(F.filter(every, lambda a: ~a.rlike(ET_AL)), lambda a: squeeze(F.regexp_replace(plain(a), r"^([^,]*),(.*)$", "$1 $2"))).alias("names"),
            F.exists(every, lambda a: a.rlike(ET_AL)).alias("more"),
        ),
    )


def shown_people(p: Column, most: int) -> Column:
    """The first names of `people` and a tail."""
    names = p["names"]
    tail = F.when(F.exists(names, lambda a: a.rlike(r"[\x{4e00}-\x{9fff}]")), "等").otherwise("et al")
    return F.when((F.size(names) <= most) & ~(p["more"] & (F.size(names) > 0)), F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(", "), tail))


def authors(t: Column, most: int = 3) -> Column:
    """Names as "Last First", the first ones and a tail."""
    return once(people(t), lambda p: shown_people(p, most))


def _if(c: Column, *parts) -> Column:
    """The parts joined if c is not empty, else an empty string."""
    return F.when(c != "", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise(F.lit(""))


def _list(glue: str, *cs: Column) -> Column:
    return F.array_join(F.filter(F.array(*cs), lambda x: x != ""), glue)


def _doi_or(doi: Column, other: Column) -> Column:
    return F.when(doi != "", F.concat(F.lit(" DOI: "), doi, F.lit("."))).otherwise(other)


def citation(entrytype: Column, fields: Column) -> Column:
    """A GB/T 7714 style citation by type of entry.

    The map of fields and the names of authors are made once, and the cleaned fields as one struct; the wording is an
    expression over that struct, so it stays small however often it mentions a field.
    """
    return once(fields, lambda given: once(people(field(given, "author")), lambda by: once(_cleaned(entrytype, given, by), _wording)))


def _cleaned(entrytype: Column, fields: Column, by: Column) -> Column:
    f = lambda *names: field(fields, *names)
    explicit = f("url")
    how = F.try_element_at(fields, F.lit("howpublished"))
    url = F.when(explicit != "", explicit).otherwise(F.coalesce(F.nullif(url_in(how), F.lit("")), url_in(F.try_element_at(fields, F.lit("note")))))
    named = F.coalesce(F.try_element_at(fields, F.lit("author")), F.lit("")) != ""
    parts = {
        "kind": F.lower(F.coalesce(entrytype, F.lit(""))), "title": f("title"), "year": year_of(fields), "doi": f("doi"), "url": url,
        "pages": F.regexp_replace(f("pages"), "--|–", "-"), "place": f("address", "location"), "journal": f("journal", "journaltitle"),
        "volume": f("volume"), "number": f("number", "issue"), "report": f("number"), "book_title": f("booktitle"), "organization": f("organization"),
        "publisher": f("publisher"), "edition": f("edition"), "type": f("type"), "institution": f("institution"), "school": f("school"),
        "how": F.when(url_in(how) == "", plain(how)).otherwise(F.lit("")), "note": f("note"),
        "by": shown_people(by, 3), "all_by": shown_people(by, 99), "maker": F.when(named, shown_people(by, 3)).otherwise(authors(f("editor"))),
    }
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def _wording(s: Column) -> Column:
    title, year, place, doi = s["title"], s["year"], s["place"], s["doi"]
    lead, available = _if(s["by"], s["by"], ". "), _if(s["url"], " Available: ", s["url"], ".")

    online = F.lower(s["journal"]).rlike("arxiv|preprint")
    where = _list(", ", s["journal"], year, _if(s["volume"], s["volume"], _if(s["number"], "(", s["number"], ")")))
    article = F.concat(
        lead, title, F.when(online, "[EB/OL]").otherwise("[J]"), F.lit(". "), _if(where, where, _if(s["pages"], ": ", s["pages"]), "."),
        _doi_or(doi, F.when(online, available).otherwise(F.lit(""))),
    )
    talk = F.concat(
        lead, title, F.lit("[C]//"), _if(s["book_title"], s["book_title"], ". "), _if(place, place, ": "), _if(s["organization"], s["organization"], ", "), year, _if(s["pages"], ": ", s["pages"])
    )
    talk = F.concat(F.regexp_replace(talk, "[, ]+$", ""), F.lit("."), _doi_or(doi, available))

    def published(tag: str, lead_: Column, holder: Column, *rest: Column) -> Column:
        pub = _list(": ", place, holder)
        return F.concat(lead_, title, F.lit(f"{tag}. "), F.when(pub != "", F.concat(pub, _if(year, ", ", year), F.lit("."))).otherwise(_if(year, year, ".")), *rest, available)

    kind_of = _if(s["type"], " ", s["type"], ".")
    book = published("[M]", _if(s["maker"], s["maker"], ". "), s["publisher"], _if(s["edition"], " ", s["edition"], "."))
    report = published("[R]", lead, s["institution"], kind_of, _if(s["report"], " No.", s["report"], "."))
    thesis = F.concat(
        _if(s["all_by"], s["all_by"], ". "), title, F.lit("[D]. "), _if(s["school"], _if(place, place, ": "), s["school"]), _if(year, ", ", year), F.lit("."), kind_of, available
    )
    rest = _list(", ", s["how"], year)
    other = F.concat(lead, title, F.when(s["url"] != "", "[EB/OL]").otherwise("[M]"), F.lit(". "), _if(rest, rest, "."), _if(s["note"], " ", s["note"], "."), available)
    return squeeze(
        F.when(s["kind"] == "article", article)
        .when(s["kind"].isin("inproceedings", "conference", "proceedings"), talk)
        .when(s["kind"].isin("book", "inbook"), book)
        .when(s["kind"].isin("phdthesis", "mastersthesis", "thesis"), thesis)
        .when(s["kind"].isin("techreport", "report"), report)
        .otherwise(other)
    )


def split_items(files: DataFrame, blocks: bool = False) -> DataFrame:
    """(path, pos, key, body): the items of bibliography text; blocks looks inside thebibliography environments only."""
    env = r"(?s)\\begin\{thebibliography\}\{[^}]*\}(.*?)\\end\{thebibliography\}"
    part = F.explode(F.regexp_extract_all("content", F.lit(env), F.lit(1))) if blocks else F.col("content")
    parts = files.select("path", part.alias("part"))
    pairs = F.arrays_zip(F.regexp_extract_all("part", F.lit(BIBITEM), F.lit(1)).alias("key"), F.slice(F.split("part", BIBITEM, -1), 2, 1 << 30).alias("body"))
    return parts.select("path", F.posexplode(pairs).alias("pos", "item")).select("path", "pos", F.trim("item.key").alias("key"), F.trim("item.body").alias("body"))


#: How much a sentence of an item looks like names, like a title and like a venue: pattern, and the points for each of the three.
LOOKS = (
    (r"(?<![A-Za-z])[A-Z]\.", (3, -2, 0)), (r"\band\b|&|\bet[~ ]al", (2, 0, 0)), (r"^[^,]*,[^,]*,", (1, 0, 0)), (r"(?:\b[a-z]{2,}[\s:,-]+){2}[a-z]{2,}", (-3, 3, -1)),
    (r"\d", (-3, -1, 2)), (r"\b(?:1[89]\d\d|20[0-3]\d)\b", (-2, -1, 3)), (r"\d\s*[-–]+\s*\d|\bpp?\.|\bpages?\b", (-3, -3, 4)), (r"^In\b", (-2, -3, 6)), (r"\\(?:emph|textit|url|doi)\b|https?:", (-3, -2, 5)),
    (r"\b(?:Journal|J\.|Proc|Proceedings|Conference|Workshop|Transactions|Trans\.|Press|University|arXiv|vol\.|Technical Report|PhD|Springer|Elsevier)", (-2, -2, 4)),
)


def segments(body: Column) -> Column:
    """array of authors, title and venue of an item whose parts no \newblock tells apart.

    The item is cut into sentences, each with points for what it looks like; the two cuts with the most points in all are
    found in one pass, as the best ways to be within each of the three parts after each sentence.
    """
    sentences = F.filter(F.transform(F.split(squeeze(body), r"(?<=[.?!])(?<!(?<![A-Za-z])[A-Z]\.)\s+"), squeeze), lambda x: x != "")
    return once(sentences, _segments)


def _segments(sentences: Column) -> Column:
    def points(x: Column) -> Column:
        """The points of a sentence for each of the three parts; each pattern is looked for once."""
        hits = F.array(*(x.rlike(pattern) for pattern, _ in LOOKS))
        total = lambda h, part: sum((F.when(F.get(h, k), score[part]).otherwise(0) for k, (_, score) in enumerate(LOOKS) if score[part]), F.lit(0))
        return once(hits, lambda h: F.array(*(total(h, part) for part in range(3))))

    def step(acc: Column, x: Column) -> Column:
        i = acc["i"]
        in_title = F.when(acc["a"] >= acc["t"], F.struct(acc["a"].alias("s"), i.alias("c"))).otherwise(F.struct(acc["t"].alias("s"), acc["tc"].alias("c")))
        in_venue = F.when(acc["t"] >= acc["v"], F.struct(acc["t"].alias("s"), acc["tc"].alias("c"), i.alias("d"))).otherwise(F.struct(acc["v"].alias("s"), acc["vc"].alias("c"), acc["vd"].alias("d")))
        return F.struct(
            (i + 1).alias("i"), (acc["a"] + F.get(x, 0)).alias("a"), (in_title["s"] + F.get(x, 1)).alias("t"), in_title["c"].alias("tc"),
            (in_venue["s"] + F.get(x, 2)).alias("v"), in_venue["c"].alias("vc"), in_venue["d"].alias("vd"),
        )

    least = -(1 << 30)
    zero = F.struct(*(F.lit(x).alias(n) for n, x in (("i", 0), ("a", 0), ("t", least), ("tc", 0), ("v", least), ("vc", 0), ("vd", 0))))

    def cut(r: Column) -> Column:
        # a title at least, if there is more than one sentence; the venue may be missing
        first = F.when(r["i"] < 2, 0).when(r["v"] >= r["t"], r["vc"]).otherwise(r["tc"])
        second = F.when((r["i"] < 2) | (r["v"] < r["t"]), r["i"]).otherwise(r["vd"])
        piece = lambda a, n: F.array_join(F.slice(sentences, a + 1, n), " ")
        return F.array(piece(F.lit(0), first), piece(first, second - first), piece(second, r["i"] - second))

    return F.aggregate(F.transform(sentences, points), zero, step, cut)


def names_of(text: Column) -> Column:
    """The names of an item's authors, joined as BibTeX does: parted by commas, semicolons, "and"; initials behind a last name stay with it."""
    t = F.regexp_replace(F.regexp_replace(text, "~", " "), r"[.\s]+$", "")
    alike = F.regexp_replace(t, r"(?i),?\s*\bet\s+al\b\.?", " and et al")
    # "Last, F. M." keeps its comma where only initials follow
    parts = F.split(alike, r"\s*;\s*|\s*,?\s+(?:and|&)\s+|\s*,\s*+(?!(?:[A-Z]\.[\s-]*)+(?:,|$|\s+and\s|;))")
    return F.array_join(F.filter(F.transform(parts, F.trim), lambda x: x != ""), " and ")


def parse_item(body: Column) -> Column:
    """struct of the fields of an item: its parts are told by \newblock, or by what they look like where there is none."""
    clean = lambda t: squeeze(F.regexp_replace(F.regexp_replace(t, r"\{?\\natexlab\{[^}]*\}\}?", ""), r"\\penalty0\s*", ""))
    marked = F.transform(F.split(body, r"\\newblock"), clean)
    blocks = F.when(body.contains("\\newblock"), F.concat(F.slice(marked, 1, 2), F.array(F.array_join(F.slice(marked, 3, 1 << 30), " ")))).otherwise(segments(clean(body)))

    def fields(b: Column) -> Column:
        lead, head, venue = (F.coalesce(F.get(b, i), F.lit("")) for i in range(3))
        strip = lambda t: F.regexp_replace(plain(t), r"[.,\s]+$", "")
        volume = lambda g: F.regexp_extract(venue, r"(\d+)(?:\s*\(([^)]*)\))?\s*[:,]\s*(?:pp?\.?\s*)?(\d+\s*[-–]+\s*\d+)", g)
        pages = F.coalesce(F.nullif(volume(3), F.lit("")), F.regexp_extract(venue, r"(?i)\bpages?\s+(\d+\s*[-–]+\s*\d+)", 1))
        number = r"\b(1[89]\d\d|20[0-3]\d)\b"
        tail = r"[,.\s]+(1[89]\d\d|20[0-3]\d)[.\s]*$"
        year = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(venue, r"\d+\s*[-–]+\s*\d+", ""), number, 1), F.lit("")), F.nullif(F.regexp_extract(head, tail, 1), F.lit("")), F.regexp_extract(body, number, 1))
        emphasised = F.nullif(F.regexp_extract(venue, r"\\emph\{([^}]+)\}", 1), F.lit(""))
        named = F.nullif(strip(F.regexp_extract(venue, r"^\s*(?:In[:\s]+)?([^\d,(]+)", 1)), F.lit(""))
        return F.struct(
            F.regexp_replace(plain(lead), r"[.\s]+$", "").alias("authors"), names_of(lead).alias("author"), strip(F.regexp_replace(head, tail, "")).alias("title"),
            F.coalesce(emphasised, named, strip(venue)).alias("venue"),
            F.coalesce(F.nullif(volume(1), F.lit("")), F.regexp_extract(venue, r"(?i)\bvolume[~\s]*(\d+)", 1)).alias("volume"), volume(2).alias("number"), F.regexp_replace(pages, r"\s*[-–]+\s*", "-").alias("pages"),
            year.alias("year"),
            F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(body, r"\\doi\{([^}]+)\}", 1), r"^https?://doi\.org/", ""), F.lit("")), F.regexp_extract(body, r"(10\.\d{4,}/[^\s}]+)", 1)).alias("doi"),
            url_in(body).alias("url"),
            F.when(venue.rlike(r"^\s*In\b"), "inproceedings").when(emphasised.isNotNull() | (volume(1) != ""), "article").otherwise("misc").alias("entrytype"),
        )

    return F.get(F.transform(F.array(blocks), fields), 0)


def dedup(entries: DataFrame, norm: Column, pos: str, key: str) -> DataFrame:
    """The first entry of each normalised title, with all keys of its group, sorted, as aliases."""
    rest = [c for c in entries.columns if c != key]
    return (
        entries.withColumn("_norm", norm).groupBy("_norm")
        .agg(F.min_by(F.struct(key, *rest), pos).alias("e"), F.array_sort(F.collect_set(key)).alias("aliases")).select("e.*", "aliases")
    )


def alone(entries: DataFrame, key: str) -> DataFrame:
    """Without deduplication an entry's only alias is its own key."""
    return entries.withColumn("aliases", F.array(key))


def order_columns(mode: str, year: str, key: str, pos: str) -> list[Column]:
    """file order; year, newest first and unknown last, then key; or key."""
    if mode == "file":
        return [F.col(pos)]
    if mode == "year":
        return [F.desc(F.coalesce(F.expr(f"try_cast({year} AS int)"), F.lit(-1))), F.asc(key), F.asc(pos)]
    return [F.asc(key), F.asc(pos)]


def number(entries: DataFrame, order: list[Column], start: int = 1) -> DataFrame:
    """Citation numbers in order. A bibliography is small; number_by_range serves where it is not."""
    return entries.withColumn("id", F.row_number().over(Window.orderBy(*order)) + (start - 1))


def lookup(numbered: DataFrame, text: str) -> DataFrame:
    """(key, id, citation): every alias; of a key with several entries the later wins."""
    return (
        numbered.select("id", F.col(text).alias("citation"), F.explode("aliases").alias("key"))
        .groupBy("key").agg(F.max("id").alias("id"), F.max_by("citation", "id").alias("citation"))
    )


def reference_list(lookup_: DataFrame) -> DataFrame:
    """One citation for each number."""
    return lookup_.groupBy("id").agg(F.min("citation").alias("citation"))
