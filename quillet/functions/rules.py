"""Rule sets of the document engine: one frozen value that every builder takes; configured entries extend the defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Environment names by category, in order of precedence, with the Chinese prefix of their labels.
_FIGURE = "figure figure* subfigure subfigure* subfloat wrapfigure wrapfigure* SCfigure SCfigure* floatrow ffigbox capbeside SCtable SCtable* sidewaysfigure sidewaysfigure* turnfigure captionedbox tikzpicture tikzfigure floatingfigure figwindow cutout overpic teaserfigure figurehere"
_TABLE = "table table* tabular tabular* tabularx tabularx* tabulary tabularray tblr longtblr longtable longtable* supertabular supertabular* mpsupertabular xtabular sidewaystable sidewaystable* sidewaystabular turntable threeparttable threeparttablex tabu longtabu tabbing wraptable wraptable* ttabbox ctable array spreadtab tablehere adjustbox"
_ALGORITHM = "algorithm algorithm* algorithmic algorithmicx algpseudocode algorithm2e algorithm2e* codebox pseudocode lstpseudocode myalgorithm algo proc procedure function"
_CODE = "lstlisting minted minted* verbatim verbatim* Verbatim Verbatim* BVerbatim LVerbatim SaveVerbatim alltt verbatimtab listing tcolorbox tcblisting mdframed spverbatim comment codeblock sourcecode pycode bashcode jsoncode xmlcode sqlcode exampleblock example"
_MATH = "equation equation* displaymath align align* aligned alignat alignat* alignedat gather gather* gathered multline multline* flalign flalign* split cases cases* dcases dcases* rcases rcases* numcases subequations eqnarray eqnarray* empheq dmath dmath* dseries dseries* dgroup dgroup* darray darray* IEEEeqnarray IEEEeqnarray* math"
CATEGORIES = (("figure", "图", _FIGURE), ("table", "表", _TABLE), ("algorithm", "算法", _ALGORITHM), ("code", "代码", _CODE), ("math", "式", _MATH))
# Environments that are paragraphs of their own.
BLOCK_ENVS = tuple(
    "abstract figure figure* table table* equation equation* align align* aligned gather gather* multline multline* flalign flalign* eqnarray eqnarray* itemize enumerate description quote quotation verse center flushleft flushright algorithm algorithm* algorithmic lstlisting verbatim thebibliography".split()
)
# Environments that are not translated, but for their captions.
SKIP_ENVS = tuple(
    "equation equation* align align* aligned alignat alignat* gather gather* gathered multline multline* flalign flalign* split cases cases* dcases dcases* rcases rcases* math displaymath subequations "
    "figure figure* subfigure subfloat wrapfigure SCfigure minipage center tikzpicture picture pspicture floatrow ffigbox "
    "table table* tabular tabular* tabularx tabulary tabularray longtable supertabular xtab array tabbing sidewaystable subtable "
    "verbatim verbatim* alltt lstlisting minted tcolorbox mdframed algorithm algorithm* algorithmic algorithmicx algorithm2e algpseudocode".split()
)
# Section titles with a standing translation.
TITLES = {
    "abstract": "摘要", "introduction": "引言", "background": "背景", "related work": "相关工作", "related works": "相关工作", "preliminaries": "预备知识",
    "problem formulation": "问题建模", "problem statement": "问题描述", "methodology": "方法论", "method": "方法", "methods": "方法", "approach": "方法",
    "proposed method": "所提方法", "model": "模型", "framework": "框架", "architecture": "架构", "experiment": "实验", "experiments": "实验",
    "experimental setup": "实验设置", "experimental results": "实验结果", "evaluation": "评估", "results": "结果", "results and discussion": "结果与讨论",
    "analysis": "分析", "ablation study": "消融实验", "discussion": "讨论", "conclusion": "结论", "conclusions": "结论", "conclusion and future work": "结论与展望",
    "future work": "未来工作", "limitations": "局限性", "acknowledgement": "致谢", "acknowledgements": "致谢", "acknowledgment": "致谢", "acknowledgments": "致谢",
    "references": "参考文献", "appendix": "附录", "supplementary material": "补充材料", "supplementary": "补充材料", "notation": "符号说明", "overview": "概述",
}
# Environments of formulas, and commands that point, whose markup has to survive a transformation.
FORMULAS = "equation align gather multline flalign alignat".split()
REFERENCES = "ref eqref autoref cref Cref hyperref pageref".split()


def _syntax() -> dict[str, str]:
    """The pattern of each category of such markup: commands with a group, and what stands between a pair of marks."""
    group, any_of = r"\{[^}]+\}", lambda names: f"(?:{'|'.join(names)})"
    between = lambda a, b, least: f"(?s){a}.{'+' if least else '*'}?{b}"
    formula = any_of(FORMULAS) + r"\*?\}"
    return {
        "cite": r"\\cite[a-zA-Z]*\*?" + group, "inline_math": between(r"\$\$?", r"\$\$?", 1), "display_math": between(r"\\\[", r"\\\]", 1),
        "math_env": between(r"\\begin\{" + formula, r"\\end\{" + formula, 0), "ref": r"\\" + any_of(REFERENCES) + r"\*?" + group,
        "label": r"\\label" + group, "footnote": r"\\footnote\{",
    }


SYNTAX = _syntax()


@dataclass(frozen=True)
class Rules:
    """Everything that configures the engine. Extending returns a new value; nothing is global."""

    categories: tuple[tuple[str, str, frozenset], ...] = tuple((c, p, frozenset(e.split())) for c, p, e in CATEGORIES)
    block_envs: frozenset = frozenset(BLOCK_ENVS)
    skip_envs: frozenset = frozenset(SKIP_ENVS)
    titles: Mapping[str, str] = field(default_factory=lambda: dict(TITLES))
    syntax: Mapping[str, str] = field(default_factory=lambda: dict(SYNTAX))
    cite_placeholder: str = "[未找到]"
    max_batch_tokens: int = 1500

    def extend(self, config: Mapping) -> Rules:
        """These rules with those of a configuration added; entries that are not understood are left out."""
        strings = lambda v: {str(x).strip() for x in v if str(x).strip()} if isinstance(v, (list, tuple, set)) else set()
        known = {c: (p, e) for c, p, e in self.categories}
        for name, c in (config.get("env_categories") or {}).items():
            if isinstance(c, Mapping):
                prefix, envs = known.get(name, ("", frozenset()))
                prefix, envs = str(c.get("prefix") or prefix), envs | strings(c.get("envs"))
                if prefix and envs:
                    known[name] = (prefix, frozenset(envs))
        return replace(
            self,
            categories=tuple((c, p, e) for c, (p, e) in known.items()),
            block_envs=self.block_envs | strings(config.get("chunk_block_envs")),
            skip_envs=self.skip_envs | strings(config.get("skip_envs")),
            titles={**self.titles, **{str(k).strip().lower(): str(v) for k, v in (config.get("section_titles") or {}).items()}},
            syntax={**self.syntax, **{str(k): str(v) for k, v in (config.get("syntax_patterns") or {}).items() if _compiles(v)}},
        )

    @property
    def env_rows(self) -> list[tuple[str, str, str, int]]:
        """(env, category, prefix, rank); of an environment in two categories the first wins."""
        seen: dict[str, tuple[str, str, str, int]] = {}
        for rank, (c, p, envs) in enumerate(self.categories):
            for e in sorted(envs):
                seen.setdefault(e, (e, c, p, rank))
        return list(seen.values())


def _compiles(pattern: object) -> bool:
    import re

    try:
        re.compile(str(pattern))
    except re.error:
        return False
    return True
