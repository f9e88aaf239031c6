"""What regular expressions cannot do to LaTeX: balanced groups, macros, formatting, tables. Plain functions, and Arrow UDFs over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

#: What an expansion has to look at: commands, escaped characters and comments; all else is copied as it lies.
_MARKUP = re.compile(r"\\[A-Za-z]+\*?|\\.|%[^\n]*\n?", re.S)
_BRACES, _BRACKETS = re.compile(r"\\.|[{}]", re.S), re.compile(r"\\.|[\[\]]", re.S)


def pairs(s: str, marks: re.Pattern = _BRACES) -> dict[int, int]:
    """The place behind the end of every group of a text, by the place of its beginning; groups that never end are absent.
    One pass, however many groups stay open."""
    ends, held = {}, []
    for m in marks.finditer(s):
        c = m[0]
        if c in "{[":
            held.append(m.start())
        elif c in "}]" and held:
            ends[held.pop()] = m.end()
    return ends


class Source:
    """A text with its groups, which are looked for once, when the first is asked for."""

    def __init__(self, text: str) -> None:
        self.text, self._ends = text, {}

    def end(self, at: int, marks: re.Pattern = _BRACES) -> int:
        """The place behind the group that opens at `at`; -1 if it never ends."""
        if marks not in self._ends:
            self._ends[marks] = pairs(self.text, marks)
        return self._ends[marks].get(at, -1)

    def argument(self, at: int) -> tuple[str, int] | None:
        s, at = self.text, skip_space(self.text, at)
        if at >= len(s):
            return None
        if s[at] == "{":
            end = self.end(at)
            return None if end < 0 else (s[at + 1 : end - 1], end)
        m = _ARGUMENT.match(s, at)
        return m[0], m.end()

    def optional(self, at: int) -> tuple[str | None, int]:
        start = skip_space(self.text, at)
        if self.text[start : start + 1] == "[":
            end = self.end(start, _BRACKETS)
            if end > 0:
                return self.text[start + 1 : end - 1], end
        return None, at


def group_end(s: str, at: int, opener: str = "{", closer: str = "}") -> int:
    """The place behind the group that opens at `at`; -1 if it never ends. Escaped characters do not count."""
    depth = 0
    for m in (_BRACES if opener == "{" else _BRACKETS).finditer(s, at):
        if m[0] == opener:
            depth += 1
        elif m[0] == closer:
            depth -= 1
            if not depth:
                return m.end()
    return -1


_SPACE, _ARGUMENT = re.compile(r"\s*"), re.compile(r"\\(?:[A-Za-z]+|.)|.", re.S)


def skip_space(s: str, at: int) -> int:
    return _SPACE.match(s, at).end()


def argument(s: str, at: int) -> tuple[str, int] | None:
    """A mandatory argument: a group's content, a control word or one character."""
    at = skip_space(s, at)
    if at >= len(s):
        return None
    if s[at] == "{":
        end = group_end(s, at)
        return None if end < 0 else (s[at + 1 : end - 1], end)
    m = _ARGUMENT.match(s, at)
    return m[0], m.end()


def optional(s: str, at: int) -> tuple[str | None, int]:
    start = skip_space(s, at)
    if start < len(s) and s[start] == "[":
        end = group_end(s, start, "[", "]")
        if end > 0:
            return s[start + 1 : end - 1], end
    return None, at


def title(tex: str | None) -> str | None:
    """The content of the title command outside comments, line breaks as blanks."""
    s = re.sub(r"(?<!\\)%[^\n]*", "", tex or "")
    m = re.search(r"\\title\s*(?:\[[^\]]*\])?\s*\{", s)
    end = group_end(s, m.end() - 1) if m else -1
    return " ".join(re.sub(r"\\\\|\n", " ", s[m.end() : end - 1]).split()) if end > 0 else None


@dataclass
class Macro:
    args: int
    default: str | None
    body: str
    end: str | None = None  # of an environment

    def apply(self, values: list[str], body: str) -> str:
        return re.sub(r"#([1-9])", lambda m: values[int(m[1]) - 1] if int(m[1]) <= len(values) else "", body)


class Expander:
    """One pass from left to right: a definition holds from where it stands and stays in the text; comments are kept.

    What a macro makes is read in turn before what follows it, from a stack, so macros may nest as deep as they like. The work
    has a budget, of expansions and of characters that they make, both in proportion to the text: macros that never end
    spend it, and what was still to be expanded then stays as it is and is counted in `left`.
    """

    _DEFINE = ("newcommand", "renewcommand", "providecommand", "def", "gdef", "edef", "xdef", "DeclareMathOperator", "newenvironment", "renewenvironment")

    def __init__(self, expansions: int = 1000, characters: int = 1_000_000) -> None:
        self.least, self.macros, self.envs, self.left = (expansions, characters), {}, {}, 0

    def _define(self, s: Source, name: str, at: int) -> int | None:
        """Read a definition command's arguments; where it ends, or none if it is malformed."""
        if name in ("def", "gdef", "edef", "xdef"):
            m = re.compile(r"\s*\\([A-Za-z]+)((?:#\d)*)\s*").match(s.text, at)
            body = s.argument(m.end()) if m and s.text[m.end() : m.end() + 1] == "{" else None
            if body:
                self.macros[m[1]] = Macro(m[2].count("#"), None, body[0])
                return body[1]
            return None
        if name in ("newenvironment", "renewenvironment"):
            who = s.argument(at)
            if not who:
                return None
            n, at = s.optional(who[1])
            default, at = s.optional(at)
            first = s.argument(at)
            last = s.argument(first[1]) if first else None
            if not last:
                return None
            proof = re.search(r"\\endproof\b", last[0])
            self.envs[who[0].strip()] = Macro(int(n) if (n or "").isdigit() else 0, default, "\\begin{proof}" if proof else first[0], "\\end{proof}" if proof else last[0])
            return last[1]
        who = s.argument(at)
        if not who or not re.fullmatch(r"\s*\\[A-Za-z]+\s*", who[0]):
            return None
        word = who[0].strip()[1:]
        if name == "DeclareMathOperator":
            body = s.argument(who[1])
            if body:
                self.macros[word] = Macro(0, None, f"\\operatorname{{{body[0]}}}")
            return body[1] if body else None
        n, at = s.optional(who[1])
        default, at = s.optional(at)
        body = s.argument(at)
        if body:
            self.macros[word] = Macro(int(n) if (n or "").isdigit() else 0, default, body[0])
        return body[1] if body else None

    def _values(self, m: Macro, s: Source, at: int) -> tuple[list[str], int] | None:
        values = []
        if m.default is not None:
            own, at = s.optional(at)
            values.append(m.default if own is None else own)
        while len(values) < m.args:
            got = s.argument(at)
            if not got:
                return None
            values.append(got[0])
            at = got[1]
        return values, at

    def _made(self, s: Source, token: str, at: int) -> tuple[str, int] | None:
        """What a command at hand makes and where it ends, if it is a macro or belongs to an environment of its own."""
        if token in ("\\begin", "\\end"):
            who = s.argument(at) if self.envs else None
            env = self.envs.get(who[0].strip()) if who else None
            got = env and (self._values(env, s, who[1]) if token == "\\begin" else ([], who[1]))
            return (env.apply(got[0], env.body if token == "\\begin" else env.end), got[1]) if got else None
        macro = self.macros.get(token[1:]) if token[0] == "\\" else None
        got = self._values(macro, s, at) if macro else None
        return (macro.apply(got[0], macro.body), got[1]) if got else None

    def expand(self, tex: str) -> str:
        expansions, characters = self.least[0] + 8 * len(tex), self.least[1] + 64 * len(tex)
        out, stack = [], [(Source(tex), 0)]
        while stack:
            s, at = stack.pop()
            while m := _MARKUP.search(s.text, at):
                token = m[0]
                out.append(s.text[at : m.start()])
                at = m.end()
                if token[0] == "\\" and token[1:].rstrip("*") in self._DEFINE:
                    end = self._define(s, token[1:].rstrip("*"), at)
                    if end is not None:
                        out.append(s.text[m.start() : end])
                        at = end
                        continue
                elif made := self._made(s, token, at):
                    if expansions > 0 and characters >= len(made[0]):
                        expansions, characters = expansions - 1, characters - len(made[0])
                        stack += [(s, made[1]), (Source(made[0]), 0)]
                        break
                    self.left += 1
                out.append(token)
            else:
                out.append(s.text[at:])
        return "".join(out)


def expand_macros(tex: str | None) -> str | None:
    return expansion(tex)[0]


def expansion(tex: str | None) -> tuple[str | None, int]:
    """The text with its macros expanded, and how many uses the budget of work left as they were."""
    if tex is None or "\\" not in tex:
        return tex, 0
    e = Expander()
    return e.expand(tex), e.left


# Formatting commands by what becomes of them.
UNWRAP = "textbf textit texttt textrm textsf textsc textsl textup textmd textnormal emph underline mbox hbox uline sout".split()
UNWRAP_LAST = {"textcolor": 2, "colorbox": 2, "fcolorbox": 3, "scalebox": 2, "resizebox": 3, "raisebox": 2, "parbox": 2, "href": 0}
SWITCHES = "bfseries itshape ttfamily rmfamily sffamily scshape slshape upshape mdseries normalfont bf it tt rm sf sc sl em tiny scriptsize footnotesize small normalsize large Large LARGE huge Huge centering raggedright raggedleft noindent indent smallskip medskip bigskip newpage clearpage pagebreak linebreak newline par vfill hfill protect".split()
SPACING = "vspace hspace setlength addtolength vskip hskip thispagestyle pagestyle setcounter addtocounter".split()
# Environments whose content is not text, apart from their starred forms.
VERBATIM = "equation align alignat gather multline flalign eqnarray displaymath math verbatim Verbatim lstlisting minted alltt".split()
_OPENS = re.compile(r"\\begin\{(" + "|".join(VERBATIM) + r")(\*?)\}|\\verb\*?([^A-Za-z\s])|\\[(\[]|\\.|\$\$?", re.S)
_DOLLAR = re.compile(r"(?:[^$\\]|\\.)*\$", re.S)
_WRAPPER = re.compile(r"\\(" + "|".join(map(re.escape, sorted([*UNWRAP, *(k for k, v in UNWRAP_LAST.items() if v)], key=len, reverse=True))) + r")\*?(?![A-Za-z])")
_SPACING = re.compile(r"\\(?:" + "|".join(SPACING) + r")\*?(?:\s*\{[^{}]*\}|\s*\[[^\]]*\])+")
_SWITCH = re.compile(r"\\(?:" + "|".join(sorted(SWITCHES, key=len, reverse=True)) + r")(?![A-Za-z])[ \t]?")


def protected(s: str) -> list[tuple[int, int]]:
    """The places of formulas and verbatim text, in order. What is not found behind one place is not looked for again."""
    zones, at, absent = [], 0, set()

    def ends(closer: str, start: int) -> int:
        found = -1 if closer in absent else s.find(closer, start)
        if found < 0:
            absent.add(closer)
        return found + len(closer) if found >= 0 else -1

    while m := _OPENS.search(s, at):
        token, end = m[0], -1
        if m[1]:
            end = ends(f"\\end{{{m[1]}{m[2]}}}", m.end())
        elif m[3]:
            end = ends(m[3], m.end())
        elif token in ("\\(", "\\["):
            end = ends({"\\(": "\\)", "\\[": "\\]"}[token], m.end())
        elif token[0] == "$":
            start = m.end()
            while token == "$$" and (end := ends("$$", start)) > 0 and s[end - 3] == "\\":
                start = end - 1
            if end < 0 and "$" not in absent:
                own = _DOLLAR.match(s, m.start() + 1)
                end = own.end() if own else -1
                absent |= {"$"} if end < 0 else set()
        if end > 0:
            zones.append((m.start(), end))
        at = max(m.end(), end)
    return zones


def _unwrapped(s: str) -> str:
    """Text without wrapping commands, their options and all arguments but the last, of which the content stays."""
    src, kept, at, done = Source(s), [], 0, 0
    closing: set[int] = set()
    options: list[tuple[int, int]] = []  # behind last arguments, the next on top
    while m := _WRAPPER.search(s, at):
        while options and options[-1][0] <= m.start():
            at = max(at, options.pop()[1])
        if m.start() < at:
            continue
        last, end = -1, src.optional(m.end())[1]
        for _ in range(UNWRAP_LAST.get(m[1], 1)):
            last = skip_space(s, end)
            close = src.end(last) if s[last : last + 1] == "{" else -1
            if close < 0:
                last = -1
                break
            end = src.optional(close)[1] if s[close : close + 1] == "[" else close
        at = m.end()
        if last >= 0:
            # the braces of the last argument go with the command; an option behind it as well
            kept.append((done, m.start()))
            done = at = last + 1
            closing.add(close - 1)
            if end > close:
                closing.add(close)
                options.append((close, end))
    kept.append((done, len(s)))
    out = []
    for a, b in kept:
        for c in sorted(x for x in closing if a <= x < b) if len(closing) < 8 else _between(closing, a, b, s):
            out.append(s[a:c])
            a = c + 1 if s[c] == "}" else src.end(c, _BRACKETS)
        out.append(s[a:b])
    return "".join(out)


def _between(places: set[int], a: int, b: int, s: str) -> list[int]:
    return [m.start() for m in re.compile(r"[}\[]").finditer(s, a, b) if m.start() in places]


def strip_formatting(tex: str | None) -> str | None:
    """Text without formatting: wrappers leave their content, switches and spacing go, forced line breaks become new lines; math and verbatim stay as they are."""
    if tex is None:
        return None
    kept, bits, at = [], [], 0
    for a, b in protected(tex):
        kept.append(tex[a:b])
        bits += [tex[at:a], f"\x00{len(kept) - 1}\x00"]
        at = b
    s = _unwrapped("".join([*bits, tex[at:]]))
    s = _SWITCH.sub("", _SPACING.sub("", s))
    closed = s.rfind("]") + 1  # no option ends behind it
    s = re.sub(r"\\\\\*?(?:\[[^\]]*\])?", "\n", s[:closed]) + re.sub(r"\\\\\*?", "\n", s[closed:])
    before = None
    while before != s:  # groups that no command owns
        before, s = s, re.sub(r"(^|[\s(\x00])\{([^{}\\]*)\}", r"\1\2", s)
    s = re.sub(r"[ \t]+\n", "\n", re.sub(r"[ \t]{2,}", " ", s))
    s = re.sub(r"\n{3,}", "\n\n", s)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], s)


# Signs for math commands in table cells.
SYMBOLS = {"times": "×", "pm": "±", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "sim": "∼", "infty": "∞", "cdot": "·", "ldots": "…", "dots": "…", "rightarrow": "→", "to": "→", "leftarrow": "←", "uparrow": "↑", "downarrow": "↓", "checkmark": "✓", "star": "★", "dagger": "†", "ddagger": "‡", "circ": "°", "bullet": "•", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "sum": "∑", "prod": "∏", "sqrt": "√", "partial": "∂", "nabla": "∇", "in": "∈", "subset": "⊂", "cup": "∪", "cap": "∩", "forall": "∀", "exists": "∃", "div": "÷", "ll": "≪", "gg": "≫", "propto": "∝", "angle": "∠", "perp": "⊥", "parallel": "∥"}
_STYLE = {"textbf": "bold", "bf": "bold", "bfseries": "bold", "mathbf": "bold", "textit": "italic", "emph": "italic", "it": "italic", "itshape": "italic", "underline": "underline", "uline": "underline", "textsuperscript": "superscript", "textsubscript": "subscript"}

_COMMAND, _UNSTYLED, _BLANKS = re.compile(r"\\([A-Za-z]+)\*?"), re.compile(r"[^\\{^_$]*"), {ord("~"): " ", ord("\n"): " "}


def spans(cell: str) -> list[dict]:
    """Runs of equal style of a table cell."""
    out: list[dict] = []

    def add(text: str, style: frozenset) -> None:
        if not text:
            return
        if out and out[-1]["_s"] == style:
            out[-1]["text"] += text
        else:
            out.append({"_s": style, "text": text, **{k: k in style for k in ("bold", "italic", "underline", "superscript", "subscript")}})

    def walk(s: str, style: frozenset) -> None:
        at = 0
        while at < len(s):
            if s[at] == "\\" and (m := _COMMAND.match(s, at)):
                at = m.end()
                if m[1] in _STYLE:
                    at2 = skip_space(s, at)
                    if s[at2 : at2 + 1] == "{":
                        inside, at = argument(s, at2)
                        walk(inside, style | {_STYLE[m[1]]})
                    else:
                        style = style | {_STYLE[m[1]]}
                elif m[1] in SYMBOLS:
                    add(SYMBOLS[m[1]], style)
                elif m[1] in ("cellcolor", "rowcolor", "color", "label", "hspace", "vspace"):
                    _, at = optional(s, at)
                    at = (argument(s, at) or ("", at))[1] if s[skip_space(s, at) : skip_space(s, at) + 1] == "{" else at
                elif m[1] == "textcolor":
                    at = (argument(s, at) or ("", at))[1]
            elif s[at] == "\\" and at + 1 < len(s):
                add({"\\": " "}.get(s[at + 1], s[at + 1]), style)
                at += 2
            elif s[at] == "{" and (end := group_end(s, at)) > 0:
                walk(s[at + 1 : end - 1], style)
                at = end
            elif s[at] in "^_" and at + 1 < len(s):
                got = argument(s, at + 1)
                walk(got[0], style | {"superscript" if s[at] == "^" else "subscript"})
                at = got[1]
            elif s[at] == "$":
                at += 1
            else:  # what no sign in it ends, or one sign
                end = _UNSTYLED.match(s, at + 1).end()
                add(s[at:end].translate(_BLANKS), style)
                at = end

    walk(cell.strip(), frozenset())
    return [{k: v for k, v in r.items() if k != "_s"} for r in out]


def columns(spec: str) -> list[str]:
    """Alignment of each column of a tabular specification: l, c, r; paragraphs and unknown ones are l."""
    out, at = [], 0
    while at < len(spec):
        c = spec[at]
        at += 1
        if c == "*":
            n = argument(spec, at)
            inner = argument(spec, n[1]) if n else None
            if inner:
                out += columns(inner[0]) * (int(n[0]) if n[0].isdigit() else 1)
                at = inner[1]
        elif c in "@!><" and spec[at : at + 1] == "{":
            at = max(at, group_end(spec, at))
        elif c in "lcr":
            out.append(c)
        elif c.isalpha():
            out.append("l")
            if spec[at : at + 1] == "{":
                at = max(at, group_end(spec, at))
    return out


_CELL_SIGNS = re.compile(r"\\.|[{}&]", re.S)


def cells(row: str) -> list[str]:
    """A row cut at ampersands outside groups."""
    out, depth, start = [], 0, 0
    for m in _CELL_SIGNS.finditer(row):
        if m[0] == "&" and not depth:
            out.append(row[start : m.start()])
            start = m.end()
        elif m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
    return [*out, row[start:]]


def _tabular(tex: str | None) -> tuple[list[str], list[tuple[str, str | None]]] | None:
    """Alignments of the columns and the rows, each with its colour, of the first tabular of a text."""
    m = re.search(r"\\begin\{(tabular[xy*]?|longtable\*?|tabulary|tblr)\}", tex or "")
    if not m:
        return None
    at = m.end()
    if m[1] in ("tabularx", "tabular*", "tabulary"):
        at = (argument(tex, at) or ("", at))[1]
    _, at = optional(tex, at)
    spec = argument(tex, at)
    end = tex.find(f"\\end{{{m[1]}}}", spec[1] if spec else at)
    if not spec or end < 0:
        return None
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|endhead|endfirsthead|endfoot|centering)\b|\\c(?:line|midrule)(?:\([^)]*\))?\{[^}]*\}", "", tex[spec[1] : end])
    rows = []
    for raw in re.split(r"\\\\(?:\[[^\]]*\])?|\n\s*\n", body):
        if raw.strip():
            color = re.search(r"\\rowcolor(?:\[[^\]]*\])?\{([^}]*)\}", raw)
            rows.append((re.sub(r"\\rowcolor(?:\[[^\]]*\])?\{[^}]*\}", "", raw), color and color[1]))
    return columns(spec[0]), rows


def table(tex: str | None) -> dict | None:
    """caption, column count and alignments, rows of cells (as styled runs) of the first tabular of a text."""
    found = _tabular(tex)
    if not found:
        return None
    align, raws = found
    rows = []
    for raw, color in raws:
        group = re.fullmatch(r"\s*\\multicolumn\{(\d+)\}\{[^}]*\}(\{.*\})\s*", raw, re.S)
        if group and int(group[1]) >= max(2, len(align)):
            rows.append({"type": "group", "bg_color": color, "span": int(group[1]), "cells": [spans(group[2])]})
            continue
        own = []
        for c in cells(raw):
            multi = re.match(r"\s*\\multicolumn\{(\d+)\}\{[^}]*\}", c)
            own.append(spans(c[multi.end() :] if multi else re.sub(r"\\multirow\{[^}]*\}(?:\[[^\]]*\])?\{[^}]*\}", "", c)))
            own += [[]] * (int(multi[1]) - 1 if multi else 0)
        own = (own + [[]] * len(align))[: len(align) or len(own)]
        rows.append({"type": "data" if any(r["type"] in ("header", "data", "group") for r in rows) else "header", "bg_color": color, "span": 1, "cells": own})
    cap = re.search(r"\\caption\*?(?:\[[^\]]*\])?\{", tex)
    cap_end = group_end(tex, cap.end() - 1) if cap else -1
    return {"caption": tex[cap.end() : cap_end - 1] if cap_end > 0 else "", "col_count": len(align), "col_align": align, "rows": rows}


def spanning(cell: str) -> tuple[str, int, int, str | None]:
    """(content, columns, rows, alignment) of a cell: what multicolumn and multirow wrap, in either order."""
    wide, high, align, s = 1, 1, None, Source(cell.strip())
    while m := re.match(r"\\multi(column|row)(?![A-Za-z])", s.text):
        at = s.optional(m.end())[1] if m[1] == "row" else m.end()
        count = s.argument(at)
        how = s.argument(s.optional(count[1])[1]) if count else None  # a specification, or a width behind an option
        content = s.argument(s.optional(how[1])[1]) if how else None
        if not content or not re.fullmatch(r"\s*-?\d+\s*", count[0]):
            break
        if m[1] == "column":
            wide, align = max(1, int(count[0])), next(iter(columns(how[0])), None)
        else:
            high = int(count[0]) or 1
        s = Source(content[0].strip())
    return s.text, wide, high, align


def grid(tex: str | None) -> list[dict] | None:
    """The cells of the first tabular of a text, each with its place and the rows and columns that it spans.

    Places are kept in a table of who holds them. A cell of several rows holds those below it, where a row writes nothing;
    a row that does write there ends it. One that counts its rows upwards takes the empty cells above. What goes beyond the
    table is cut off; places that a row leaves out are empty cells.
    """
    found = _tabular(tex)
    if not found:
        return None
    align, rows = found
    most = len(align) or max((sum(spanning(c)[1] for c in cells(raw)) for raw, _ in rows), default=0)
    held: dict[tuple[int, int], dict] = {}
    out: list[dict] = []

    def place(row: int, col: int, wide: int, high: int, content: str, own: str | None, color: str | None) -> None:
        cell = {
            "row": row, "col": col, "row_span": high, "col_span": wide, "align": own or (align[col] if col < len(align) else "l"), "shade": color, "runs": spans(content),
        }
        out.append(cell)
        for r in range(row, row + high):
            for c in range(col, col + wide):
                held[r, c] = cell

    def cut(cell: dict, row: int) -> None:
        """From this row on a cell holds nothing."""
        for r in range(row, cell["row"] + cell["row_span"]):
            for c in range(cell["col"], cell["col"] + cell["col_span"]):
                held.pop((r, c), None)
        cell["row_span"] = row - cell["row"]

    for r, (raw, color) in enumerate(rows):
        col = 0
        for text in cells(raw):
            content, wide, high, own = spanning(text)
            wide = min(wide, most - col)
            if wide <= 0:
                break
            if (r, col) in held and not content:
                col += wide
                continue
            for c in range(col, col + wide):
                if (r, c) in held:
                    cut(held[r, c], r)
            row = r
            if high < 0:  # as far up as there are empty cells of this width
                above = lambda k: held.get((k, col), {"runs": 1})
                while row > 0 and r - row + 1 < -high and not above(row - 1)["runs"] and (above(row - 1)["row_span"], above(row - 1)["col_span"]) == (1, wide):
                    row -= 1
                    out.remove(above(row))
                high = r - row + 1
            place(row, col, wide, min(high, len(rows) - row), content, own, color)
            col += wide
        for c in range(most):
            if (r, c) not in held:
                place(r, c, 1, 1, "", None, color)
    return sorted(out, key=lambda x: (x["row"], x["col"]))


def footnotes(tex: str | None) -> tuple[str | None, list[str]]:
    """The text with the mark STX n ETX for its n-th footnote command, from 1, and what the footnotes say."""
    if tex is None or "\\footnote" not in tex:
        return tex, []
    s, out, notes, at = Source(tex), [], [], 0
    for m in re.finditer(r"\\footnote(?![A-Za-z])(?:\s*\[[^\]]*\])?\s*(?=\{)", tex):
        end = s.end(m.end()) if m.start() >= at else -1
        if end > 0:
            notes.append(tex[m.end() + 1 : end - 1].strip())
            out += [tex[at : m.start()], f"\x02{len(notes)}\x03"]
            at = end
    return "".join([*out, tex[at:]]), notes


SPAN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,superscript:boolean,subscript:boolean>"
TABLE = f"struct<caption:string,col_count:int,col_align:array<string>,rows:array<struct<type:string,bg_color:string,span:int,cells:array<array<{SPAN}>>>>>"


GRID = f"array<struct<row:int,col:int,row_span:int,col_span:int,align:string,shade:string,runs:array<{SPAN}>>>"


def drop_arguments(s: str, count: int) -> str:
    """s without its first `count` groups, an option before each with it."""
    src, at = Source(s), 0
    for _ in range(count):
        start = skip_space(s, src.optional(at)[1])
        end = src.end(start) if s[start : start + 1] == "{" else -1
        if end < 0:
            break
        at = end
    return s[at:]


#: Characters of texts that are at hand as Python strings at once, or one text.
AT_ONCE = 1 << 20


def _udf(f: Callable, kind: str):
    """Texts of a batch are taken out of it and given back in pieces, so what a task holds does not grow with its rows."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            held, size = [], 0
            for x in b:
                held.append(f(x.as_py()))
                size += len(held[-1] or "")
                if size >= AT_ONCE:
                    yield pa.array(held, pa.string())
                    held, size = [], 0
            if held or not len(b):
                yield pa.array(held, pa.string())

    return run


def text_udf(f: Callable[[str | None], str | None]):
    """An Arrow UDF over a text function."""
    return _udf(f, "string")


def table_udf():
    @F.pandas_udf(TABLE)
    def run(s: pd.Series) -> pd.DataFrame:
        empty = {"caption": None, "col_count": None, "col_align": None, "rows": None}
        return pd.DataFrame([table(x) or empty for x in s], columns=list(empty))

    return run
