"""The English analyzer: stop words and the Porter2 suffix rules, as column expressions over distinct words.

The rules are a chain of named columns, each of which reads the former ones. They keep to expressions that Spark and
DuckDB share, so that the same chain is the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that the English analyzer drops.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()
# Words that the rules would get wrong, and words that keep their form after step 1a.
_WHOLE = dict(x.split("=") for x in "skis=ski skies=sky dying=die lying=lie tying=tie idly=idl gently=gentl ugly=ugli early=earli only=onli singly=singl sky=sky news=news howe=howe atlas=atlas cosmos=cosmos bias=bias andes=andes".split())
_KEEP = "inning outing canning herring earring proceed exceed succeed".split()
# Suffixes of steps 2 to 4 and what takes their place.
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

#: A word of the analyzer: letters and digits; underscores and marks part words.
WORD = r"[\p{L}\p{N}]+"


def _any(suffixes) -> str:
    return "(" + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + ")$"


def _swap(w: str, suffix: str, table: dict[str, str]) -> str:
    return f"concat(left({w}, length({w}) - length({suffix})), CASE {suffix} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END)"


_V, _C = "[aeiouy]", "[^aeiouy]"
_SHORT = f"({_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def rules(has: str, every: str) -> list[tuple[str, str]]:
    """(column, expression) over the column `word`, in lower case. `has` and `every` are the engine's way to say that a
    pattern matches, and that all matches are replaced."""
    match = lambda w, p: has.format(w=w, p=p)
    replace = lambda w, p, by: every.format(w=w, p=p, by=by)
    first = lambda w, p: f"regexp_replace({w}, '{p}', '')"
    within = lambda w, suffix, start: f"length({w}) - length({suffix}) >= {start}"
    end = lambda w, n: f"left({w}, length({w}) - {n})"
    return [
        ("w0", replace("regexp_replace(word, '^y', 'Y')", "([aeiouy])y", "{1}Y")),
        ("r1", f"CASE WHEN {match('w0', f'(^(gener|commun|arsen)|{_V}{_C})')} THEN length(regexp_extract(w0, '^(gener|commun|arsen|.*?{_V}{_C})', 1)) ELSE length(w0) END"),
        ("r2", f"CASE WHEN {match('substr(w0, r1 + 1)', f'{_V}{_C}')} THEN r1 + length(regexp_extract(substr(w0, r1 + 1), '^(.*?{_V}{_C})', 1)) ELSE length(w0) END"),
        ("w1", f"CASE WHEN {match('w0', 'sses$')} THEN {end('w0', 2)} WHEN {match('w0', '..ie[ds]$')} THEN {end('w0', 2)} WHEN {match('w0', 'ie[ds]$')} THEN {end('w0', 1)} WHEN {match('w0', '(us|ss)$')} THEN w0 WHEN {match('w0', f'{_V}.+s$')} THEN {end('w0', 1)} ELSE w0 END"),
        ("still", "w1 IN (" + ", ".join(f"'{k}'" for k in _KEEP) + ")"),
        ("s1", "regexp_extract(w1, '(eedly|ingly|edly|eed|ing|ed)$', 1)"),
        ("w2", f"CASE WHEN s1 IN ('eed', 'eedly') THEN CASE WHEN {within('w1', 's1', 'r1')} THEN concat({first('w1', '(eedly|eed)$')}, 'ee') ELSE w1 END WHEN s1 <> '' AND {match('left(w1, length(w1) - length(s1))', _V)} THEN left(w1, length(w1) - length(s1)) ELSE w1 END"),
        ("cut", "s1 IN ('ed', 'edly', 'ing', 'ingly') AND w2 <> w1"),
        ("w3", f"CASE WHEN NOT cut THEN w2 WHEN {match('w2', '(at|bl|iz)$')} THEN concat(w2, 'e') WHEN {match('w2', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {end('w2', 1)} WHEN r1 >= length(w2) AND {match('w2', _SHORT)} THEN concat(w2, 'e') ELSE w2 END"),
        ("w4", f"CASE WHEN {match('w3', f'.{_C}[yY]$')} THEN concat({end('w3', 1)}, 'i') ELSE w3 END"),
        ("s2", f"regexp_extract(w4, '{_any(_STEP2)}', 1)"),
        ("ok2", f"s2 <> '' AND {within('w4', 's2', 'r1')} AND (s2 <> 'ogi' OR {match('w4', 'logi$')}) AND (s2 <> 'li' OR {match('w4', '[cdeghkmnrt]li$')})"),
        ("w5", f"CASE WHEN ok2 THEN {_swap('w4', 's2', _STEP2)} ELSE w4 END"),
        ("s3", f"regexp_extract(w5, '{_any(_STEP3)}', 1)"),
        ("w6", f"CASE WHEN s3 <> '' AND {within('w5', 's3', 'r1')} AND (s3 <> 'ative' OR {within('w5', 's3', 'r2')}) THEN {_swap('w5', 's3', _STEP3)} ELSE w5 END"),
        ("s4", f"regexp_extract(w6, '{_any(_STEP4)}', 1)"),
        ("w7", f"CASE WHEN s4 <> '' AND {within('w6', 's4', 'r2')} AND (s4 <> 'ion' OR {match('w6', '[st]ion$')}) THEN left(w6, length(w6) - length(s4)) ELSE w6 END"),
        ("w8", f"CASE WHEN {match('w7', 'e$')} AND (length(w7) - 1 >= r2 OR (length(w7) - 1 >= r1 AND NOT {match(end('w7', 1), _SHORT)})) THEN {end('w7', 1)} WHEN {match('w7', 'll$')} AND length(w7) - 1 >= r2 THEN {end('w7', 1)} ELSE w7 END"),
        ("stem", "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _WHOLE.items()) + " ELSE CASE WHEN length(word) <= 2 THEN word WHEN still THEN w1 ELSE " + replace("w8", "Y", "y") + " END END"),
    ]


_SPARK = rules("regexp_like({w}, '{p}')", "regexp_replace({w}, '{p}', '{by}')")
_DUCK = rules("regexp_matches({w}, '{p}')", "regexp_replace({w}, '{p}', '{by}', 'g')")


def stems(words: DataFrame) -> DataFrame:
    """`words` with the column `stem` of its column `word` (lower case). Each rule is one projection, so no expression is
    written out twice; a null word has a null stem."""
    out = words
    for name, expression in _SPARK:
        out = out.withColumn(name, F.expr(expression.replace("{1}", "$1")))
    return out.select(*words.columns, "stem")


def stems_sql(table: str) -> str:
    """The same over a DuckDB table with a column `word`: a query of (word, stem)."""
    for name, expression in _DUCK:
        table = f"(SELECT *, {expression.replace('{1}', chr(92) + '1')} AS {name} FROM {table})"
    return f"(SELECT word, stem FROM {table})"


def is_stop(word):
    return word.isin(*STOP)
