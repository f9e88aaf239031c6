"""Render-time text: Column builders that tidy fragments, titles, captions, environments and settings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rewrite

# Chinese characters and marks; marks after which no blank stands.
_CJK, _MARKS = r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}", "。，、；：！？…—“”‘’「」『』【】《》（）·.,;:!?"
# Settings a request may change, by group.
RENDERING = {"fonts": ("body", "heading", "caption", "code", "ascii"), "sizes": ("body", "h1", "h2", "h3", "caption", "code"), "colors": ("theorem_bg", "code_bg", "table_bg")}
# Environments of which a fragment keeps the content alone, with the number of arguments that may follow
# their beginning; switches without content; environments whose formula ends without a mark.
SHELLS = {"em": 0, "wraptable": 2, "tabular": 2, "tabular*": 2, "proof": 0}
SWITCHES = ("bf", "toprule", "midrule", "bottomrule")
UNMARKED_MATH = ("equation", "align", "gather", "multline", "flalign", "alignat")
# Old font switches in formulas, and the commands that take their places.
MATH_FONTS = {"rm": "mathrm", "bf": "mathbf", "it": "mathit", "sf": "mathsf", "tt": "mathtt", "cal": "mathcal"}
# Commands that go with their arguments, and how many those are.
BOXES = {"raisebox": 2, "includegraphics": 1}


def _balanced(depth: int) -> str:
    """What braces hold that are nested at most `depth` deep."""
    return r"[^{}]*" if depth == 0 else rf"(?:[^{{}}]++|\{{{_balanced(depth - 1)}\}})*+"


def _stripped(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s++|(?<!\s)\s++$", "")


def clean_spaces(t: Column) -> Column:
    """No blanks around Chinese characters and after marks; single ones between others.

    White space and what it parts are tokens; of each white space the characters beside it decide.
    """
    tokens = F.regexp_extract_all(t, F.lit(r"(?U)\s++|\S++"), F.lit(0))

    def join(all_: Column) -> Column:
        def token(x: Column, i: Column) -> Column:
            left, right = F.right(F.coalesce(F.get(all_, i - 1), F.lit("")), F.lit(1)), F.left(F.coalesce(F.get(all_, i + 1), F.lit("")), F.lit(1))
            goes = left.rlike(f"[{_CJK}{_MARKS}]") | right.rlike(f"[{_CJK}]")
            one = left.rlike("[!-~]") & right.rlike("[!-~]") & x.rlike(r"^ {2,}\z")
            return F.when(x.rlike(r"(?U)^\S"), x).when(goes, "").when(one, " ").otherwise(x)

        return F.array_join(F.transform(all_, token), "")

    return F.get(F.transform(F.array(tokens), join), 0)


def clean_section_suffix(t: Column) -> Column:
    """One 节 after a numbered section or chapter."""
    return F.regexp_replace(t, r"(?<=第[0-9.]{1,20}[节章])\s*节", "")


def clean_title(t: Column) -> Column:
    """A title's words: no comments, images, boxes or commands.

    A fold over the tokens of the title. `open` holds, for each open brace, what becomes of it: kept, taken off with its
    command, or gone with all that it holds; `due` counts the arguments that a box still takes.
    """
    tokens = F.regexp_extract_all(t, F.lit(r"(?s)%[^\n]*|\\[a-zA-Z]+\*?|\\.|[{}]|\[[^\]]*\]|\s+|[^\\{}%\[\s]+|."), F.lit(0))
    state = "struct<out:array<string>,open:array<string>,due:int,after:boolean>"
    nothing = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("due"), F.lit(False).alias("after"))

    def step(acc: Column, x: Column) -> Column:
        gone = F.array_contains(acc["open"], "gone")
        command = x.rlike(r"^\\[a-zA-Z]")
        due = F.lit(0)
        for name, n in BOXES.items():
            due = F.when(x == f"\\{name}", n).otherwise(due)
        what = F.when(gone | (acc["due"] > 0), "gone").when(acc["after"], "off").otherwise("kept")
        top = F.when(F.size(acc["open"]) > 0, F.element_at(acc["open"], -1)).otherwise("kept")
        option = (acc["after"] | (acc["due"] > 0)) & x.startswith("[")
        blank = x.rlike(r"^\s+$")
        said = (
            F.when(gone | command | option | x.startswith("%"), "").when(x == "{", F.when(what == "kept", x).otherwise(""))
            .when(x == "}", F.when(top == "kept", x).otherwise("")).when(x == "\\\\", " ").otherwise(x)
        )
        return F.struct(
            F.concat(acc["out"], F.array(said)).alias("out"),
            F.when(x == "{", F.concat(acc["open"], F.array(what))).when((x == "}") & (F.size(acc["open"]) > 0), F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1)).otherwise(acc["open"]).alias("open"),
            F.when(gone, acc["due"]).when(command, due).when((x == "{") & (acc["due"] > 0), acc["due"] - 1).when((x == "}") | option | blank, acc["due"]).otherwise(0).cast("int").alias("due"),
            F.when(command, F.lit(True)).when(option, acc["after"]).when(blank & (acc["due"] > 0), acc["after"]).otherwise(F.lit(False)).alias("after"),
        ).cast(state)

    words = F.array_join(F.aggregate(tokens, nothing.cast(state), step, lambda acc: acc["out"]), "")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def _cut(t: Column, name: str, starred: bool) -> Column:
    """struct(found, ended, before, option, body, after) around the first environment of a name: the text is split at its
    beginning, and the rest at its end."""
    marker = lambda word: rf"(?i)\\{word}\{{{re.escape(name)}{'[*]?' if starred else ''}\}}"
    at_start = F.split(t, marker("begin"), 2)
    rest = F.get(at_start, 1)
    option = F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)
    at_end = F.split(F.regexp_replace(rest, r"^\[[^\]]*\]", ""), marker("end"), 2)
    return F.struct(
        (F.size(at_start) > 1).alias("found"), (F.size(at_end) > 1).alias("ended"), _stripped(F.get(at_start, 0)).alias("before"),
        F.trim(option).alias("option"), _stripped(F.get(at_end, 0)).alias("body"), _stripped(F.coalesce(F.get(at_end, 1), F.lit(""))).alias("after"),
    )


def environment(t: Column, name: str) -> Column:
    """struct(option, body) of the first environment of a name; the whole text is the body if there is none that ends."""
    cut = _cut(t, name, True)
    hit = F.coalesce(cut["found"] & cut["ended"], F.lit(False))
    return F.struct(F.when(hit, cut["option"]).otherwise("").alias("option"), F.when(hit, cut["body"]).otherwise(t).alias("body"))


def around_environment(t: Column, name: str) -> Column:
    """struct(before, body, after) of the first environment of a name; an open one takes the rest."""
    cut = _cut(t, name, False)
    part = lambda c, other: F.when(cut["found"], cut[c]).otherwise(other).alias(c)
    return F.struct(part("before", t), part("body", F.lit("")), part("after", F.lit("")))


def caption(t: Column) -> Column:
    """The first caption with braces at most one level deep, else an empty string."""
    pieces = F.slice(F.split(t, r"\\caption\{", -1), 2, 1 << 20)
    inner = F.transform(pieces, lambda x: F.regexp_extract(x, rf"^({_balanced(1)})\}}", 0))
    whole = F.get(F.filter(inner, lambda x: x != ""), 0)
    return F.coalesce(F.trim(F.substring(whole, F.lit(1), F.length(whole) - 1)), F.lit(""))


def sanitize(t: Column, keep_proofs: bool = False) -> Column:
    """A fragment without what makes no sense outside its environment: shells, rules, emphasis switches; captions as text.

    A shell's beginning goes with its option and with as many arguments as its environment takes.
    """
    shells = {n: k for n, k in SHELLS.items() if not (keep_proofs and n == "proof")}
    named = lambda names: rf"\{{(?:{'|'.join(map(re.escape, names))})\}}"
    gone = [r"bf(?U:(?!\w))\s*+", rf"(?:{'|'.join(s for s in SWITCHES if s != 'bf')})(?U:(?!\w))", "end" + named(shells)]
    for n in sorted(set(shells.values())):
        gone.append("begin" + named(s for s, k in shells.items() if k == n) + r"(?:\[[^\]]*\])?" + rf"(?:\{{[^}}]*\}}){{0,{n}}}" * (n > 0))
    t = F.array_join(F.split(t, rf"\\(?:{'|'.join(gone)})", -1), "")
    t = rewrite(t, rf"\\caption\{{({_balanced(1)})\}}", lambda content: content)
    return _stripped(F.regexp_replace(t, r"(?<![ \t])[ \t]++(?=\n)|(?<=\n\n)\n+", ""))


def strip_trailing_punctuation(t: Column) -> Column:
    """Display math without a comma or full stop before its end: the text is cut at these ends, and each piece before one
    loses what it ends in."""
    end = rf"\\end\{{(?:{'|'.join(UNMARKED_MATH)})\*?\}}"
    pieces = F.split(t, rf"(?={end})", -1)
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i < F.size(pieces) - 1, F.regexp_replace(x, r"[,.]\s*+$", "")).otherwise(x)), "")


def math_fonts(t: Column) -> Column:
    """Inline formulas with commands for old font switches that stand before a group or a blank; all other text as it is."""

    def formula(inner: Column) -> Column:
        names = F.regexp_extract_all(inner, F.lit(rf"\\({'|'.join(MATH_FONTS)})(?=[\s{{])"), F.lit(1))
        new = F.create_map(*(F.lit(x) for pair in MATH_FONTS.items() for x in pair))
        pieces = F.split(inner, rf"\\(?:{'|'.join(MATH_FONTS)})(?=[\s{{])", -1)
        put = F.transform(names, lambda n: F.concat(F.lit("\\"), F.try_element_at(new, n)))
        return F.concat(F.lit("$"), F.array_join(F.zip_with(pieces, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""), F.lit("$"))

    return F.when(t.contains("$"), rewrite(t, r"(?<!\\)\$((?:[^$\\]++|\\.)++)\$", formula)).otherwise(t)


def display_math(t: Column) -> Column:
    """The first display-math environment, else the text."""
    p = r"(?is)\\begin\{((?:equation|displaymath|align|alignat|gather|multline|flalign|eqnarray|dmath|IEEEeqnarray|math)\*?)\}.*?\\end\{\1\}"
    return F.when(t.rlike(p), F.regexp_extract(t, p, 0)).otherwise(t)


def panels(t: Column) -> Column:
    """array<struct<images, caption>> of the minipages and subfigures that hold any."""
    p = r"(?s)\\begin\{(?:minipage|subfigure|subfloat)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)\\end\{(?:minipage|subfigure|subfloat)\}"
    found = F.transform(
        F.regexp_extract_all(t, F.lit(p), F.lit(1)),
        lambda c: F.struct(F.regexp_extract_all(c, F.lit(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}"), F.lit(1)).alias("images"), caption(c).alias("caption")),
    )
    return F.filter(found, lambda x: (F.size(x["images"]) > 0) | (x["caption"] != ""))


def rendering_settings(group: str, settings: Column) -> Column:
    """The allowed settings of a group (map<string,string>): sizes from 6 to 72, six-digit colours, names of at most 80 characters."""
    known = F.map_filter(settings, lambda k, v: k.isin(*RENDERING[group]) & v.isNotNull())
    if group == "sizes":
        clean = lambda v: F.greatest(F.lit(6), F.least(F.lit(72), v.try_cast("int"))).cast("string")
        return F.transform_values(F.map_filter(known, lambda k, v: v.try_cast("int").isNotNull()), lambda k, v: clean(v))
    if group == "colors":
        color = lambda v: F.upper(F.regexp_replace(F.trim(v), "^#+", ""))
        return F.transform_values(F.map_filter(known, lambda k, v: color(v).rlike("^[0-9A-F]{6}$")), lambda k, v: color(v))
    return F.transform_values(F.map_filter(known, lambda k, v: F.trim(v) != ""), lambda k, v: F.substring(F.trim(v), 1, 80))


def merged(base: Column, over: Column) -> Column:
    """One map over another: entries of the latter win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(over, k), F.lit(False))), F.coalesce(over, F.create_map().cast("map<string,string>")))


def iso_utc(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
