"""Formula lines: detection, LaTeX by tokens, compounds by the table of elements.

A formula is cut into tokens; a token that has a LaTeX name takes it. What is left
is shape: scripts, roots, fractions and limits, each one rule over operands, which are
bracketed groups or names with their scripts. Compounds are words that consist of element
symbols, brackets and counts, whichever compounds they are. Rules neither look around nor refer
back, so that SQL can state them: a rule is a pattern and a template in which %1 is its first group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.text import count_contained, let, strip

#: What a relation is, and the signs and names of which two make a relation a formula.
RELATION = "[=<>]"
SIGNS = ("=", "+", "-", "*", "/", "^", "_", "->", "<=>", "\\sqrt", "sqrt", "lim", "int", "sin", "cos", "tg", "ln")
#: Letters of prose: small ones of any script. Notes in one script take that script's alone, such as [а-яА-ЯёЁ].
PROSE = "\\p{Ll}"
#: The Greek letters with a LaTeX command, in alphabetical order; capitals that differ from Latin ones.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
GREEK_CAPITALS = "Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
#: Letters with another command than their name, other names, and operators.
NAMES = {"eps": "varepsilon", "epsilon": "varepsilon", "phi": "varphi", "inf": "infty", "infinity": "infty", "int": "int", "sum": "sum"}
OPERATORS = {"!=": "neq", "*": "cdot", "+-": "pm", "±": "pm", "-->": "rightarrow", "->": "rightarrow", "<->": "Leftrightarrow", "<=": "le", "<=>": "Leftrightarrow", ">=": "ge", "~=": "approx", "≈": "approx"}
#: Element symbols by atomic number, and the elements that go in pairs.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
PAIRED = ("H", "N", "O", "F", "Cl", "Br", "I")

TOKEN = "sqrt|[A-Za-z]+|[0-9]+|<=>|<->|-->|->|!=|>=|<=|\\+-|~=|[\\s\\S]"
LATEX = {g: f"\\{g}" for g in (*GREEK, *GREEK_CAPITALS)} | {k: f"\\{v}" for k, v in NAMES.items()} | {k: f" \\{v} " for k, v in OPERATORS.items()}

_GROUP, _NAME = "\\(([^()]+)\\)", "\\\\?[A-Za-z0-9]+"
_OPERAND = f"(?:{_GROUP}|((?:\\\\sqrt\\{{[^{{}}]*\\}}|{_NAME})(?:[_^]\\{{[^{{}}]*\\}})*))"
SHAPES = [
    (f"([_^])\\s*(?:{_GROUP}|(-?{_NAME}))", "%1{%2%3}"),
    (f"\\\\?sqrt\\s*(?:{_GROUP}|({_NAME}))", "\\sqrt{%1%2}"),
    (f"{_OPERAND}\\s*/\\s*{_OPERAND}", "\\frac{%1%2}{%3%4}"),
    (f"lim\\s*({_NAME})\\s*\\\\rightarrow\\s*(-?{_NAME})", "\\lim_{%1 \\to %2}"),
    ("\\s+", " "),
]

REACTION_TOKEN = "<=>|<->|-+>|[A-Za-z0-9()]+(?:-[A-Z][A-Za-z0-9()]*)*|[\\s\\S]"
ARROW = "->|<=>"
#: Element symbols, brackets and counts, after a factor.
COMPOUND = f"^[0-9]*\\(?(?:{'|'.join(ELEMENTS)})(?:{'|'.join(ELEMENTS)}|[0-9()-])*$"
TWO_ELEMENTS = "[A-Z].*[A-Z]"
COUNTED, NAMED = "[A-Za-z)][0-9]", "[a-z]|[A-Za-z]OH$"
PAIR = f"^[0-9]*(?:{'|'.join(PAIRED)})2$"
SUBSCRIPTS = [("([A-Z()-][A-Za-z()-]*)([0-9]*)", "\\text{%1}_{%2}"), ("_\\{\\}", ""), ("_\\{([0-9])\\}", "_%1")]
#: The signs of one character as a class: a label's formula has one at least, and besides them words, numbers, brackets and points.
WORKED = f"[{''.join(sorted((x for x in SIGNS if len(x) == 1), key=lambda x: x == '-'))}]"
LABELLED = f"^([^:]*:)\\s*([A-Za-z0-9()\\s.{WORKED[1:]}+)$"


def shaped(t: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules in order over the whole text."""
    for pattern, template in rules:
        t = F.regexp_replace(t, pattern, template.replace("\\", "\\\\").replace("%", "$"))
    return t


def is_formula(t: Column, prose: str = PROSE) -> Column:
    """A relation with few letters of prose (a class of characters) or with two signs of formulas, or a text that starts or ends as a block formula."""
    s = strip(t)
    letters = (F.length(s) - F.length(F.regexp_replace(s, prose, ""))) / F.greatest(F.lit(1), F.length(F.replace(s, F.lit(" "))))
    return (s != "") & ((s.rlike(RELATION) & ((letters < 0.45) | (count_contained(s, SIGNS) >= 2))) | s.startswith("$$") | s.endswith("$$"))


def _tokens(t: Column, pattern: str) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(0))


def to_latex(t: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LATEX.items() for x in kv])
    return strip(shaped(F.array_join(F.transform(_tokens(t, TOKEN), lambda x: F.coalesce(F.try_element_at(names, x), x)), ""), SHAPES))


def _compound(w: Column) -> Column:
    """Several elements with a count or with a small letter or hydroxide, so not a word in capitals."""
    return w.rlike(COMPOUND) & w.rlike(TWO_ELEMENTS) & (w.rlike(COUNTED) | w.rlike(NAMED)) | w.rlike(PAIR)


def _counted_element(w: Column) -> Column:
    return w.rlike(COMPOUND) & w.rlike(COUNTED)


def chemistry(t: Column) -> Column:
    """Compounds and counted elements with subscripts, arrows as commands."""
    arrow = F.lit("\\rightarrow")
    double = F.lit("\\Leftrightarrow")
    one = lambda x: F.when(x.isin("<=>", "<->"), double).when(x.rlike("^-+>$"), arrow).when(_compound(x) | _counted_element(x), shaped(x, SUBSCRIPTS)).otherwise(x)
    return F.array_join(F.transform(_tokens(t, REACTION_TOKEN), one), "")


def mentions(t: Column) -> Column:
    """Compounds in prose as inline formulas."""
    return F.array_join(F.transform(_tokens(t, REACTION_TOKEN), lambda x: F.when(_compound(x), F.concat(F.lit("$"), shaped(x, SUBSCRIPTS), F.lit("$"))).otherwise(x)), "")


def line_kind(t: Column) -> Column:
    """blank, ready (has block marks), reaction, equation, labelled (a label, then a formula) or prose."""
    s = strip(t)
    words = _tokens(s, REACTION_TOKEN)
    reacts = F.exists(words, _compound) | (s.rlike(ARROW) & F.exists(words, _counted_element))
    labelled = s.rlike(LABELLED) & F.regexp_extract(s, LABELLED, 2).rlike(WORKED)
    return F.when(s == "", "blank").when(F.contains(s, F.lit("$$")), "ready").when(~is_formula(s), F.when(labelled, "labelled").otherwise("prose")).when(reacts, "reaction").otherwise("equation")


def format_line(t: Column) -> Column:
    """The line by its kind: a block, an inline formula after its label, or prose with its compounds."""

    def block(x: Column) -> Column:
        return F.concat(F.lit("$$"), x, F.lit("$$"))

    def by_kind(x: Column) -> Column:
        s, kind = x["s"], x["kind"]
        inline = F.concat(F.regexp_extract(s, LABELLED, 1), F.lit(" $"), to_latex(F.regexp_extract(s, LABELLED, 2)), F.lit("$"))
        return F.when(kind == "reaction", block(chemistry(s))).when(kind == "equation", block(to_latex(s))).when(kind == "labelled", inline).when(kind == "prose", mentions(s)).otherwise(s)

    return let(F.struct(strip(t).alias("s"), line_kind(t).alias("kind")), by_kind)


#: What starts a chapter.
CHAPTER = "^(lecture|theme|chapter|kapitel|chapitre|capítulo)([^\\p{L}]|$)"
NUMBERED, BULLET, TERM = "^[0-9]+[.)]\\s+", "^[•*–—-]\\s*", "^(.*?)\\s*[-—]\\s*(.*)$"


def markdown_line(t: Column) -> Column:
    """A line as markdown: block formula, chapter, bullet, number, heading, definition or prose; null if blank."""
    return let(F.struct(format_line(t).alias("s"), is_formula(t).alias("f")), lambda x: _markdown(x["s"], x["f"]))


def _apart(*parts: Column | str) -> Column:
    return F.concat(F.lit("\n"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))


def _markdown(s: Column, formula: Column) -> Column:
    listed = F.when(s.startswith("•") | s.startswith("-"), F.concat(F.lit("- "), F.regexp_replace(s, BULLET, ""))).when(s.rlike(NUMBERED), _apart(s))
    defined = F.contains(s, F.lit(" - "))
    heading = s.endswith(":") | ((F.length(s) < 50) & ~defined & s.rlike("^\\p{Lu}"))
    term = _apart("**", strip(F.regexp_extract(s, TERM, 1)), "** — ", strip(F.regexp_extract(s, TERM, 2)))
    prose = F.when(heading, _apart("## ", s)).when(defined | F.contains(s, F.lit(" — ")), term).otherwise(s)
    return F.when(s == "", F.lit(None).cast("string")).when(formula, _apart(s)).when(F.lower(s).rlike(CHAPTER), _apart("### ", s)).otherwise(F.coalesce(listed, prose))
