"""Column functions on message text."""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from .bind import let
from .literals import array_map, str_array

# FIXED VALUES: characters stripped from both ends of a text (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "               　"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def normalize(c: Column) -> Column:
    """Null-safe text with runs of blanks and tabs collapsed and ends stripped; newlines stay."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \t]+", " "))


def truncate(c: Column, limit: int) -> Column:
    t = normalize(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def given_title(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.substring(title, 1, 255))


def derive_title(title: Column, text: Column) -> Column:
    given = given_title(title)
    short = truncate(strip(F.coalesce(text, F.lit(""))), 60)
    return F.coalesce(given, F.when(short != "", short), F.lit("Untitled investigation"))


def fingerprint(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t != "", F.md5(t))


def preview(c: Column, limit: int = 1000) -> Column:
    short = truncate(strip(F.coalesce(c, F.lit(""))), limit)
    return F.when(short != "", short)


def collapse_key(c: Column) -> Column:
    """Lower-cased text with every white-space run as one blank: the key exact duplicates share."""
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " "))


def anchors_of(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of ``pattern`` contains at least one (empty when unknown).

    The longest literal run outside groups that nothing makes optional; without
    one, the longest run of each alternative of the first group.
    """
    runs, groups, run, depth, i = [], [], "", 0, 0
    while i < len(pattern):
        token = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == "[":
            i = pattern.index("]", i + 1) + 1
        if token in "()" or depth:
            if token == "(" and not depth:
                opened = i
            depth += (token == "(") - (token == ")")
            if token == ")" and not depth:
                groups.append((pattern[opened:i - 1].removeprefix("?:"), pattern[i:i + 1]))
            literal = ""
        elif token == "|":
            return ()
        elif len(token) == 2:
            literal = token[1] if not token[1].isalnum() else ""
            if token == "\\b":
                continue
        else:
            literal = token if token.isalnum() or token in " %'-" else ""
        if literal and pattern[i:i + 1] not in ("?", "*", "{"):
            run += literal
            continue
        runs.append(run)
        run = ""
        if pattern[i:i + 1] == "{":
            i = pattern.index("}", i) + 1
    best = max([*runs, run], key=lambda x: len(x.strip())).strip()
    if best:
        return (best,)
    if not groups or groups[0][1] in ("?", "*", "{"):
        return ()
    found = [anchors_of(alternative) for alternative in _alternatives(groups[0][0])]
    return tuple(dict.fromkeys(x[0] for x in found)) if all(len(x) == 1 for x in found) else ()


def _alternatives(body: str) -> list[str]:
    out, depth = [""], 0
    for ch in body:
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def contains_any(c: Column, literals: Iterable[str]) -> Column:
    """Substring tests joined by OR; a literal that contains another one is redundant."""
    found = sorted(set(literals), key=len)
    needed = [x for i, x in enumerate(found) if not any(y in x for y in found[:i])]
    out = c.contains(needed[0])
    for x in needed[1:]:
        out = out | c.contains(x)
    return out


def matches(lower: Column, pattern: str) -> Column:
    """``rlike`` behind a cheap literal test, which rejects most rows without the full regex."""
    hit = lower.rlike("(?U)" + pattern)
    anchors = anchors_of(pattern)
    return contains_any(lower, anchors) & hit if anchors and all(anchors) else hit


def pattern_hits(lower: Column, patterns: Iterable[str]) -> Column:
    """The patterns found in the text, as an array in the given order."""
    return F.array_compact(F.array(*[F.when(matches(lower, p), F.lit(p)) for p in dict.fromkeys(patterns)]))


def _trie_regex(terms: Iterable[str], boundary: str) -> str:
    trie: dict = {}
    for term in terms:
        node = trie
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        longer = [re.escape(ch) + render(child) for ch, child in node.items() if ch]
        ends = [f"(?![{boundary}])"] if "" in node else []
        alts = longer + ends
        return alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"

    return render(trie)


def prefix_closure(terms: Iterable[str], boundary: str) -> dict[str, list[str]]:
    """Terms that, when found, imply shorter terms starting at the same place."""
    known = set(terms)
    inside = re.compile(f"[{boundary}]")
    out = {}
    for term in known:
        shorter = [term[:n] for n in range(1, len(term)) if term[:n] in known and not inside.match(term[n])]
        if shorter:
            out[term] = sorted(shorter) + [term]
    return out


def term_hits(lower: Column, terms: Sequence[str], boundary: str = "a-z0-9") -> Column:
    """Every term that occurs between non-``boundary`` characters, found in one pass.

    A single prefix-tree regex reports the longest term at each start position;
    shorter terms at that position are its prefixes and are added from a
    constant map.  The cost of a text does not grow with the number of terms.
    """
    found = F.regexp_extract_all(
        lower, F.lit(f"(?<![{boundary}])(?=({_trie_regex(terms, boundary)}))"), F.lit(1)
    )
    closure = prefix_closure(terms, boundary)
    if not closure:
        return F.array_distinct(found)
    implied = array_map(closure)
    return F.array_distinct(
        F.flatten(F.transform(found, lambda h: F.coalesce(F.try_element_at(implied, h), F.array(h))))
    )


def listed(values: Iterable[str], hits: Column) -> Column:
    """The entries of a constant list that occur in ``hits``, in list order."""
    return F.array_intersect(str_array(values), hits)


def requestive(lower: Column, patterns: Sequence[str], negations: Sequence[str], reach: int) -> Column:
    """A requesting verb occurs that is not preceded by a negation within ``reach`` characters."""
    guards = []
    for word in negations:
        for form in ([word.replace("'?", "'"), word.replace("'?", "")] if "'?" in word else [word]):
            guards.append(f"{form}\\s{{0,{reach - len(form)}}}")
    stems = [a for p in patterns for a in anchors_of(p)]
    # every verb starts a word: look no further where that cannot be
    start = f"(?<![a-z0-9])(?=[{''.join(sorted({x[0] for x in stems if x}))}])" if all(p.startswith(r"\b") for p in patterns) else ""
    exact = lower.rlike(f"(?U){start}(?={'|'.join(patterns)})(?<!{'|'.join(guards)})")
    return contains_any(lower, stems) & exact if all(stems) else exact


def first_by(values: Column, key: Column) -> Column:
    """Elements of ``values`` whose parallel ``key`` occurs for the first time, order kept."""
    return let(lambda b: F.filter(b["v"], lambda x, i: F.array_position(b["k"], F.get(b["k"], i)) == i + 1), v=values, k=key)
