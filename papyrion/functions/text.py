"""Column functions over text: tokens, canonical forms, TeX clean-up and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the data model.
TOKEN = r"(\\[A-Za-z]+)|(\\[^A-Za-z\s])|([A-Za-z0-9]+)|([^\s])"
SUBWORD = r"[a-zA-Z0-9_]+|\\?[a-zA-Z@]+"
NUMBERED_REF = r"(?i)(theorem|th\.?|thm\.?|proposition|prop\.?|lemma|lem\.?|corollary|cor\.?|definition|def\.?|example|ex\.?|remark|rem\.?)\s*((?:[IVXLCDM]+\s*\.)?\s*\d+(?:\.\d+)*)"
# Statement types in the order of the title test, and short forms after them.
TITLE_TYPES = ["theorem", "lemma", "proposition", "corollary", "definition", "remark", "example", "claim", "observation", "fact", "conjecture"]
TITLE_SHORT = {"prop": "proposition", "cor": "corollary", "def": "definition", "thm": "theorem", "lem": "lemma"}
# Dialect markers, lower case.
DIALECTS = {
    "latex": ["\\documentclass", "\\begin{document}", "\\usepackage"],
    "ams_tex": ["\\proclaim", "\\endproclaim", "\\demo", "\\enddemo", "\\input amstex", "\\documentstyle{amsppt", "\\documentstyle{ams"],
    "plain_tex": ["\\bye", "\\magnification", "\\headline", "\\footline", "\\nopagenumbers"],
}
# Words that hint at a statement type, in order.
TYPE_HINTS = {
    "definition": ["definition", "def.", "defn", "defn."],
    "lemma": ["lemma", "lem.", "lem"],
    "theorem": ["theorem", "thm.", "thm"],
    "proposition": ["proposition", "prop.", "prop"],
    "corollary": ["corollary", "cor.", "cor"],
    "remark": ["remark", "rem.", "rem"],
    "example": ["example", "ex.", "ex"],
}
# Kinds of numbered references by written form.
REF_KINDS = {"th": "theorem", "thm": "theorem", "prop": "proposition", "lem": "lemma", "cor": "corollary", "def": "definition", "ex": "example", "rem": "remark"}
# Words that carry no structure.
STRUCTURED_STOP = ["theorem", "lemma", "proposition", "corollary", "remark", "definition", "proof", "section", "chapter", "book", "paper", "notes", "lecture notes", "scholze"]
# Characters and the TeX commands they stand for.
MATH_CHARACTERS = {
    "∑": "\\sum", "∏": "\\prod", "∐": "\\coprod", "∫": "\\int", "√": "\\sqrt", "∞": "\\infty", "≤": "\\le", "≥": "\\ge", "≠": "\\neq", "≈": "\\approx", "≅": "\\cong",
    "→": "\\to", "↦": "\\mapsto", "↔": "\\leftrightarrow", "⊂": "\\subset", "⊆": "\\subseteq", "⊃": "\\supset", "⊇": "\\supseteq", "∈": "\\in", "∉": "\\notin", "∅": "\\emptyset",
    "∀": "\\forall", "∃": "\\exists", "∧": "\\wedge", "∨": "\\vee", "⊗": "\\otimes", "⊕": "\\oplus", "⊥": "\\bot", "⊤": "\\top",
    "ℤ": "\\mathbb{Z}", "ℚ": "\\mathbb{Q}", "ℝ": "\\mathbb{R}", "ℂ": "\\mathbb{C}",
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\epsilon", "ζ": "\\zeta", "η": "\\eta", "θ": "\\theta", "ι": "\\iota", "κ": "\\kappa", "λ": "\\lambda", "μ": "\\mu", "ν": "\\nu", "ξ": "\\xi",
    "π": "\\pi", "ρ": "\\rho", "σ": "\\sigma", "τ": "\\tau", "υ": "\\upsilon", "φ": "\\phi", "χ": "\\chi", "ψ": "\\psi", "ω": "\\omega",
    "Γ": "\\Gamma", "Δ": "\\Delta", "Θ": "\\Theta", "Λ": "\\Lambda", "Ξ": "\\Xi", "Π": "\\Pi", "Σ": "\\Sigma", "Υ": "\\Upsilon", "Φ": "\\Phi", "Ψ": "\\Psi", "Ω": "\\Omega",
}


def tokens(text: Column) -> Column:
    """TeX-aware tokens; commands keep their case, everything else is lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.when(t.startswith("\\"), t).otherwise(F.lower(t)))


def canonical(text: Column) -> Column:
    """Without dollar signs, delimiters apart, white space collapsed."""
    apart = F.regexp_replace(F.regexp_replace(text, r"\$", ""), r"([\[\](){},=+\-*/<>:])", " $1 ")
    return F.trim(F.regexp_replace(apart, r"\s+", " "))


def normal_label(label: Column) -> Column:
    """Lower case with runs of separators as one colon, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[:\-\s_]+", ":"), "^:+|:+$", "")


def normal_term(term: Column) -> Column:
    """Canonical key of a term: delimiters peeled (four rounds), one backslash off, lower case from five characters."""

    def peeled(out: Column, _: Column) -> Column:
        dollars = F.regexp_replace(out, r"(?s)^\$\s*(.*?)\s*\$$", "$1")
        braces = F.regexp_replace(dollars, r"(?s)^\{(.*)\}$", "$1")
        return F.regexp_replace(braces, r"(?s)^\\\(\s*(.*?)\s*\\\)$", "$1")

    begin = F.trim(F.regexp_replace(F.trim(term), r"\s*\([^)]*\)$", ""))

    def finish(out: Column) -> Column:
        core = F.regexp_replace(out, r"^\\", "")
        return F.when(F.length(core) < 5, core).otherwise(F.lower(core))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), begin, peeled, finish)


def words_of(term: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(term, F.lit(SUBWORD), F.lit(0)))


def is_subword(a: Column, b: Column) -> Column:
    """Whether the words of a are among those of b, for different non-blank terms."""
    x, y = words_of(a), words_of(b)
    return (a != b) & (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_except(x, y)) == 0)


def strip_comments(tex: Column) -> Column:
    return F.regexp_replace(tex, r"(?<!\\)%.*", "")


def dialect(tex: Column) -> Column:
    """latex, ams_tex, plain_tex or unknown, by the first group of markers that occurs."""
    low = F.lower(F.coalesce(tex, F.lit("")))
    out = F.lit("unknown")
    for name, markers in reversed(DIALECTS.items()):
        any_of = F.lit(False)
        for m in markers:
            any_of = any_of | low.contains(m)
        out = F.when(any_of, name).otherwise(out)
    return out


def type_of_title(title: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    out = F.lit("unknown")
    for needle, kind in reversed([*((t, t) for t in TITLE_TYPES), *TITLE_SHORT.items()]):
        out = F.when(low.contains(needle), kind).otherwise(out)
    return out


def type_hint(text: Column) -> Column:
    """The first statement type with a needle in the text, else null."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for kind, needles in reversed(TYPE_HINTS.items()):
        hit = F.lit(False)
        for n in needles:
            hit = hit | low.contains(n)
        out = F.when(hit, kind).otherwise(out)
    return out


# What goes from a TeX text for a prompt, and what stays of it.
CLEANING = [
    (r"\\(begin|end)\{[a-zA-Z0-9_*]+\}\s*", ""),
    (r"\\label\{[^\}]+\}\s*", ""),
    (r"\\(item|centering|newpage|clearpage)\b\s*", ""),
    (r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^}]+)\}", "$2"),
    (r"(\n\s*){3,}", "\n\n"),
]


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular expressions applied one after the other."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def clean_latex(text: Column) -> Column:
    """Structure commands out; section titles stay."""
    return F.trim(replaced(text, CLEANING))


def macros(tex: Column) -> Column:
    """map<name, body> of the preamble's macros without arguments; later kinds of definition win."""
    head = F.substring_index(tex, "\\begin{document}", 1)
    body = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
    name = r"\{\s*\\([A-Za-z@]+)\s*\}\s*"
    found = []
    for start in (r"\\newcommand\s*" + name, r"\\renewcommand\s*" + name, r"\\def\s*\\([A-Za-z@]+)\s*", r"\\DeclareMathOperator\*?\s*" + name):
        pattern = F.lit(start + body)
        found.append(F.arrays_zip(F.regexp_extract_all(head, pattern, F.lit(1)).alias("name"), F.transform(F.regexp_extract_all(head, pattern, F.lit(2)), lambda b: F.trim(b)).alias("body")))
    good = F.filter(F.concat(*found), lambda m: (m["body"] != "") & ~m["body"].rlike("#[123]"))
    last = F.aggregate(good, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: k != m["name"]), F.create_map(m["name"], m["body"])))
    return last


def sentences(text: Column) -> Column:
    """White space collapsed, split after . ? or !."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.?!])\s+")


def numbered_refs(text: Column) -> Column:
    """array<struct<kind, number, raw>> of references such as Theorem 2.1."""
    p = F.lit(NUMBERED_REF)
    zipped = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("k"), F.regexp_extract_all(text, p, F.lit(2)).alias("n"), F.regexp_extract_all(text, p, F.lit(0)).alias("raw"))
    kinds = F.create_map(*[F.lit(x) for pair in REF_KINDS.items() for x in pair])

    def made(x: Column) -> Column:
        low = F.regexp_replace(F.lower(x["k"]), r"\.$", "")
        return F.struct(F.coalesce(F.try_element_at(kinds, low), low).alias("kind"), F.regexp_replace(x["n"], r"\s+", "").alias("number"), x["raw"].alias("raw"))

    return F.transform(zipped, made)


def structured_tokens(items: Column) -> Column:
    """Distinct normal tokens of at least three characters, with their alphanumeric forms."""
    edge = r"""^[.,;:()\[\]{}"'`]+|[.,;:()\[\]{}"'`]+$"""
    normal = F.transform(items, lambda t: F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, r"\p{Cntrl}", " ")), r"\s+", " ")), edge, ""))
    good = F.filter(normal, lambda t: (F.length(t) >= 3) & ~t.isin(STRUCTURED_STOP))
    simple = F.filter(F.transform(good, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", "")), lambda t: F.length(t) >= 3)
    return F.array_distinct(F.concat(good, simple))


def math_to_tex(text: Column, table: dict[str, str] = MATH_CHARACTERS) -> Column:
    """Mathematical characters as TeX commands; others stay."""
    named = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    mapped = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(named, c), c)), "")
    return F.when(text.rlike(f"[{''.join(table)}]"), mapped).otherwise(text)


def unicode_to_tex(text: Column) -> Column:
    r"""``math_to_tex`` for display, with the long form \leq."""
    return math_to_tex(text, MATH_CHARACTERS | {"≤": "\\leq"})


def length_bucket(n: Column) -> Column:
    return F.when(n <= 6, "0-6").when(n <= 12, "7-12").when(n <= 20, "13-20").otherwise("21+")


def refs_bucket(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").otherwise("2+")


def without_tags(html: Column) -> Column:
    """Tags as spaces.  What follows the last > can't hold a tag, so no open < is searched to the end of the text."""
    rest = F.substring_index(html, ">", -1)
    head = F.left(html, F.length(html) - F.length(rest))
    return F.concat(F.regexp_replace(head, r"<[^>]+>", " "), rest)


def html_text(html: Column) -> Column:
    """Tags as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(without_tags(html), r"\s+", " "))


def quoted(text: Column) -> Column:
    r"""A pattern that matches a text as it is, whatever it holds (also \E)."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s_])", r"\\$1")


def preview(content: Column, most: int = 250) -> Column:
    """Escaped single-line preview, cut at the last space before ``most``."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"\\", r"\\\\"), "`", r"\\`"), "\n", "<br>")
    head = F.substring(flat, 1, most)
    cut = F.regexp_replace(head, r"(?s)^(.+) .*$", "$1")
    return F.when(F.length(flat) > most, F.concat(cut, F.lit("..."))).otherwise(flat)


def json_from_reply(reply: Column) -> Column:
    """The JSON object of a model's reply: after its thoughts, fenced first, then a flat object."""
    after = F.regexp_replace(reply, r"(?s)^.*</think>", "")
    fenced = F.regexp_extract(after, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(after, r"(?s)\{[^{}]*\}", 0), F.lit("")))
