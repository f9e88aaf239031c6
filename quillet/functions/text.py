"""Column builders over document text: comments, breaks, labels, references, tokens. All run inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rules

# Commands that name a place, in the order of categories, with what may stand before the key (an option, a
# star) and what stands behind it: a second argument that is shown, or one that is not.
PLACES = {"label": ("option", ""), "bibitem": ("option", ""), "hypertarget": ("", "shown"), "tag": ("star", ""), "newlabel": ("", "hidden")}
# Commands that point to a place.
POINTERS = ("ref", "eqref", "autoref", "cref", "Cref", "pageref", "nameref", "vref", "Vref", "fref")
_BEFORE = {"option": r"(?:\[[^\]]*\])?", "star": r"\*?", "": ""}


def _names(name: str, group: str = "([^}]+)") -> str:
    """The pattern of a command of PLACES up to its key."""
    return rf"\\{name}{_BEFORE[PLACES[name][0]]}\{{{group}\}}"


#: Keys are group 1, with the blanks around them; lists of keys are taken apart by keys_of.
LABELS = tuple((name, _names(name)) for name in PLACES)
CITE = r"~?\\cite[a-zA-Z*]*+(?:\s*+\[[^\]]*\])*+\s*+\{([^}]+)\}"
REF_COMMAND = rf"~?\\({'|'.join(POINTERS)})\*?\s*+\{{([^}}]+)\}}"
REF = REF_COMMAND.replace("(", "(?:", 1)
HYPERREF = r"~?\\hyperref\s*+\[([^\]]+)\]\s*+\{[^}]*\}"
SECTION = r"(?i)\\(part|chapter|section|subsection|subsubsection|subsubsubsection|paragraph|subparagraph)\*?\s*\{"


def _alternatives(names) -> str:
    return "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize_newlines(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def strip_comments(t: Column) -> Column:
    """Cut each line at the first percent sign without a backslash right before it."""
    return F.regexp_replace(t, r"(?<!\\)%[^\n]*", "")


def comment_start(line: Column) -> Column:
    """1-based place of the first percent sign after an even number of backslashes; 0 if none."""
    sign = F.lit(r"(?<!\\)(?:\\\\)*%")
    at = F.regexp_instr(line, sign)
    return F.when(at > 0, at + F.length(F.regexp_substr(line, sign)) - 1).otherwise(F.lit(0))


def document_body(t: Column) -> Column:
    """What the document environment holds; null without one."""
    pattern = r"(?s)\\begin\{document\}(.*?)\\end\{document\}"
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))


def drop_preamble(t: Column) -> Column:
    return F.regexp_replace(t, r"(?m)^[^\S\n]*+\\(maketitle|tableofcontents)[^\S\n]*+$", "")


_WHITE = " \t\n\x0b\f\r"  # what \s matches


def stripped(t: Column) -> Column:
    """t without white space around it; only its ends are looked at."""
    return F.btrim(t, F.lit(_WHITE))


def strip_outer_space(t: Column) -> Column:
    # a run of blanks is entered at its beginning alone, here and below: else a long one is read once for each of its places
    return stripped(F.regexp_replace(t, r"(?m)(?<![ \t])[ \t]++$", ""))


def collapse_blank_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"\n[ \t]*\n[ \t]*\n+", "\n\n")


def break_sections(t: Column) -> Column:
    """A line that is a section command stands between blank lines."""
    return F.regexp_replace(t, r"(?m)^([ \t]*+\\(?:part|chapter|section|subsection|subsubsection)\*?\{.*\}[ \t]*+)$", "\n$1\n")


def break_environments(t: Column, rules: Rules) -> Column:
    """Block environments begin after and end before a blank line, in the middle of a line as well.

    First every marker gets a line of its own side: what stands before a beginning, or behind an end, goes to a line
    apart. Then lines are told by the marker that they hold: one with a beginning has a blank line before it, one with
    an end alone has one behind it. An end is looked for behind closing braces alone, which keeps prose cheap.
    """
    envs = _alternatives(rules.block_envs)
    begin, end = (rf"\\{m}\{{(?:{envs})\}}" for m in ("begin", "end"))
    apart = F.regexp_replace(t, rf"(?<=\S)[ \t]*+(?={begin})|(?<=\}})(?<={_behind(rules.block_envs)})[ \t]*+(?=\S)", "\n\n")
    lines = F.transform(
        F.split(apart, "\n"),
        lambda x: F.when(x.rlike(begin), F.concat(F.lit("\n"), x)).when(x.rlike(end) & ~x.contains("\\begin{"), F.concat(x, F.lit("\n"))).otherwise(x),
    )
    return F.array_join(lines, "\n")


def _behind(envs) -> str:
    """The end markers of environments, each written out: a pattern that looks back must know its lengths."""
    return "|".join(rf"\\end\{{{re.escape(e)}\}}" for e in sorted(envs))


def env_depth(t: Column, rules: Rules) -> Column:
    """Begun minus ended block environments."""
    envs = _alternatives(rules.block_envs)
    return F.regexp_count(t, F.lit(rf"\\begin\{{(?:{envs})\}}")) - F.regexp_count(t, F.lit(rf"\\end\{{(?:{envs})\}}"))


# Commands that lay out or point and say nothing by themselves, by what each may end in.
SILENT = {"": ("label", "ref", "smallskip", "medskip", "bigskip", "noindent", "newpage", "clearpage", "appendix", "thispagestyle", "pagestyle"), "*": ("vspace", "hspace", "enlargethispage")}


def is_noncontent(t: Column) -> Column:
    """Blank, or of one kind of markup throughout: layout commands, environment shells, or bibliography commands.

    A text is cut into its markup - a command with its arguments - and what remains; nothing may remain, and the names
    of the commands tell the kind.
    """
    markup = r"\\([a-zA-Z]+\*?)(?:\s*(?:\{[^}]*\}|\[[^\]]*\]))*"
    names = F.regexp_extract_all(t, F.lit(markup), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(t, markup, ""), r"\s+", "")
    lays_out = [*SILENT[""], *(n + e for n in SILENT["*"] for e in ("", "*"))]
    kinds = (
        lambda n: n.isin(*lays_out) | n.rlike("^cite[a-zA-Z]*$"),
        lambda n: n.isin("begin", "end"),
        lambda n: n.isin("bibliography", "bibliographystyle"),
    )
    one = F.lit(False)
    for kind in kinds:
        one = one | F.forall(names, kind)
    # what begins with anything but a command is content: prose is told by its first sign
    return F.when(t.rlike(r"\A\s*+[^\\\s]"), False).otherwise((rest == "") & one)


_DEFINES = r"[^\S\n]*+\\(?:newcommand\*?|renewcommand\*?|providecommand\*?|def|gdef|edef|xdef)\b"


def strip_macro_definitions(t: Column) -> Column:
    """Lines of macro definitions go, bodies over several lines with them.

    The text is cut before each line that begins a definition. Of such a piece the lines go up to the one that closes all
    braces; a body that is still open at the end of its piece goes on in the next one.
    """

    def piece(acc: Column, x: Column) -> Column:
        lines = F.split(x, "\n")

        def line(a: Column, y: Column) -> Column:
            depth = F.greatest(F.lit(0), a["depth"] + F.regexp_count(y, F.lit(r"\{")) - F.regexp_count(y, F.lit(r"\}")))
            on = F.struct(depth.cast("int").alias("depth"), (a["gone"] + 1).cast("int").alias("gone"), (depth > 0).alias("open"))
            return F.when(a["open"], on).otherwise(a)

        begins = acc["depth"].isNotNull()  # all pieces but the first begin with a definition
        start = F.struct(F.coalesce(acc["depth"], F.lit(0)).alias("depth"), F.lit(0).alias("gone"), begins.alias("open"))
        end = F.aggregate(lines, start, line)
        rest = F.array_join(F.slice(lines, end["gone"] + 1, F.greatest(F.lit(0), F.size(lines) - end["gone"])), "\n")
        # nothing stands for a piece that goes as a whole
        return F.struct(end["depth"].alias("depth"), F.concat(acc["kept"], F.when(end["gone"] < F.size(lines), F.array(rest)).otherwise(F.array().cast("array<string>"))).alias("kept"))

    zero = F.struct(F.lit(None).cast("int").alias("depth"), F.array().cast("array<string>").alias("kept"))
    cut = F.split(F.concat(F.lit("\n"), t), rf"\n(?={_DEFINES})", -1)  # the first piece is what stands before any definition
    left = F.substring(F.array_join(F.aggregate(cut, zero, piece, lambda acc: acc["kept"]), "\n"), 2, 1 << 30)
    return F.when(t.rlike(rf"(?m)^{_DEFINES}"), left).otherwise(t)


def _keys(t: Column, category: str, rank: int, pattern: str) -> Column:
    return F.transform(
        F.regexp_extract_all(t, F.lit(pattern), F.lit(1)),
        lambda k, i: F.struct(F.lit(category).alias("category"), F.lit(rank).alias("cat_rank"), i.cast("int").alias("match_pos"), F.trim(k).alias("key")),
    )


def label_keys(t: Column) -> Column:
    """array<struct<category, cat_rank, match_pos, key>> of all commands that name a place."""
    return F.flatten(F.array(*(_keys(t, c, r, p) for r, (c, p) in enumerate(LABELS))))


def strip_labels(t: Column) -> Column:
    """The commands of PLACES go with the blanks around them, and a line break on either side; what one shows is left."""
    behind = {"shown": r"\{([^}]*)\}", "hidden": r"\{[^}]*\}", "": ""}
    first = [n for n in PLACES if PLACES[n][1] == "shown"]
    for name in first + [n for n in PLACES if n not in first]:
        command = _names(name, "[^}]+") + behind[PLACES[name][1]]
        # where blanks lead to the command they are taken from the line break or from their first on
        gone = F.regexp_replace(t, rf"(?:\n|(?<![ \t])|\G)[ \t]*+{command}[ \t]*+\n?", "$1" if name in first else "")
        t = F.when(t.contains(f"\\{name}"), gone).otherwise(t)
    return F.regexp_replace(t, r"(?<=\n\n)\n+", "")


def keys_of(raw: Column) -> Column:
    """The keys of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(raw, ","), lambda k: F.trim(k)), lambda k: k != "")


def rewrite(t: Column, pattern: str, resolve, group: int = 1) -> Column:
    """t with every match of pattern replaced by resolve(group of the match): literals and results interleaved."""
    matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    return F.array_join(
        F.zip_with(F.split(t, pattern, -1), F.transform(matches, resolve), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )


# What a resolved label begins with.
KINDS = ("图", "表", "算法", "代码", "式")


def clean_cross_references(t: Column) -> Column:
    """What substitution leaves: doubled prefixes, blanks around resolved labels, doubled suffixes.

    The text is read as prefixes, numbers, section signs, white space and all else; of each such token it is decided by those
    beside it whether it stays.
    """
    kinds = "|".join(KINDS)
    tokens = F.regexp_extract_all(t, F.lit(rf"{kinds}|小节|节|\d[\d-]*+|\s++|[^图表式算代小节\d\s]++|."), F.lit(0))

    def decide(all_: Column) -> Column:
        at = lambda i: F.coalesce(F.get(all_, i), F.lit(""))
        blank, number, kind = (lambda x: x.rlike(r"^\s")), (lambda x: x.rlike(r"^\d")), (lambda x: x.isin(*KINDS))

        def same_again(i: Column) -> Column:
            """A prefix that stands there once more, before its number."""
            x, skip = at(i), blank(at(i + 1)).cast("int")
            return kind(x) & (at(i + 1 + skip) == x) & number(at(i + 2 + skip))

        def numbered(i: Column) -> Column:
            return kind(at(i)) & (number(at(i + 1)) | same_again(i))

        def sign_again(i: Column) -> Column:
            """A section sign behind a number that has its sign."""
            skip = blank(at(i - 1)).cast("int")
            return (at(i) == "节") & at(i - 1 - skip).isin("节", "小节") & at(i - 2 - skip).rlike(r"\d$")

        def token(x: Column, i: Column) -> Column:
            lead = F.when(kind(at(i - 2)) & number(at(i - 1)), F.regexp_replace(x, r"^[ \t]++", "")).otherwise(x)
            space = F.when(same_again(i - 1) | sign_again(i + 1), "").when(numbered(i + 1), F.regexp_replace(lead, r"(?<![ \t])[ \t]++\z", "")).otherwise(lead)
            return F.when(blank(x), space).when(same_again(i) | sign_again(i), "").otherwise(x)

        return F.array_join(F.transform(all_, token), "")

    once = F.get(F.transform(F.array(tokens), decide), 0)
    return F.when(t.rlike(rf"(?:{kinds})\s*+[\d图表算代式]|节\s*+节"), once).otherwise(t)


def strip_cjk_spaces(t: Column) -> Column:
    """No blanks between Chinese characters and Latin letters or digits."""
    cjk = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
    t = F.regexp_replace(t, rf"(?U)(?<={cjk})\s++(?=[A-Za-z0-9])", "")
    return F.regexp_replace(t, rf"(?U)(?<=[A-Za-z0-9])\s++(?={cjk})", "")


def estimate_tokens(t: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(t) / 4)).cast("int")


def syntax_tokens(t: Column, rules: Rules) -> Column:
    """map<category, array<token>> of the markup that has to survive."""
    return F.create_map(*(x for c, p in rules.syntax.items() for x in (F.lit(c), F.regexp_extract_all(t, F.lit(p), F.lit(0)))))


def lost_tokens(before: Column, after: Column, rules: Rules) -> Column:
    """Tokens of before that after no longer has, runs of white space counting as one blank; as they were written.

    Both sides are brought to one form once, and told apart as sets; written forms are looked for only where some are lost.
    """
    every = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    norm = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def lost(pattern: str) -> Column:
        had = F.transform(F.array_distinct(every(before, pattern)), lambda k: F.struct(k.alias("k"), norm(k).alias("n")))
        gone = lambda s: F.array_except(F.transform(s["had"], lambda x: x["n"]), F.transform(s["has"], norm))
        both = F.array(F.struct(had.alias("had"), every(after, pattern).alias("has")))
        sets = F.transform(both, lambda s: F.struct(s["had"].alias("had"), gone(s).alias("gone")))
        written = F.transform(sets, lambda s: F.when(F.forall(s["had"], lambda x: x["k"] == x["n"]), s["gone"]).when(F.size(s["gone"]) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.filter(s["had"], lambda x: F.array_contains(s["gone"], x["n"])), lambda x: x["k"])
        ))
        return F.get(written, 0)

    return F.flatten(F.array(*(lost(p) for p in rules.syntax.values())))


def safe_name(t: Column) -> Column:
    return F.substring(F.regexp_replace(t, r"(?U)[^\p{Alnum}._-]", "_"), 1, 120)


def preview(t: Column, size: int = 600) -> Column:
    return F.when(F.length(t) > size, F.concat(F.left(t, F.lit(size)), F.lit("…"))).otherwise(t)


def chinese_number(n: Column) -> Column:
    names = F.array(*(F.lit(c) for c in "一二三四五六七八九十"))
    return F.when((n >= 1) & (n <= 10), F.get(names, (n - 1).cast("int"))).otherwise(n.cast("string"))


# Digits, and the units within a section of four digits and of sections.
DIGITS, UNITS, SECTIONS = "零一二三四五六七八九", ("千", "百", "十", ""), ("万亿", "亿", "万", "")


def chinese_numeral(n: Column) -> Column:
    """A whole number from 0 on in Chinese, of up to sixteen digits; other numbers as they are."""
    digits = F.lpad(n.cast("string"), 16, "0")

    def section(i: int) -> Column:
        own = F.substring(digits, 4 * i + 1, 4)
        said = F.concat(*(
            F.when(F.substring(own, k + 1, 1) == "0", DIGITS[0]).otherwise(F.concat(F.translate(F.substring(own, k + 1, 1), "0123456789", DIGITS), F.lit(u))) for k, u in enumerate(UNITS)
        ))
        return F.when(own == "0000", DIGITS[0]).otherwise(F.concat(F.regexp_replace(said, "零+$", ""), F.lit(SECTIONS[i])))

    whole = F.regexp_replace(F.regexp_replace(F.concat(*(section(i) for i in range(4))), "零+", "零"), "^零|零$", "")
    return F.when((n >= 0) & (n < 10**16), F.when(n == 0, DIGITS[0]).otherwise(F.regexp_replace(whole, "^一十", "十"))).otherwise(n.cast("string"))


def fraction_done(stage: Column, current: Column, total: Column) -> Column:
    """Percentage of a job: the exchange stage runs from 25 to 83, all others are given by the caller; clamped to 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(stage == "translate", 25 + 58 * current / F.greatest(total, F.lit(1))).otherwise(current)))
