"""Rules: keywords, ordered rule tables, statuses, facets, votes of groups, ranked search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: keywords of structural members, and ordered category rules (all of, any of)
COUNTED = ("колонн", "стойк", "вертикальн", "горизонтальн", "связ", "распорк", "балк", "прогон", "ригел", "фахверк", "ферм", "косоур", "стен")
EXCLUDED = ("огражден",)
CATEGORY_RULES = (
    ("shveller-gnut", ("швеллер", "гнут"), ()),
    ("ugolok-gnut", ("уголок", "гнут"), ()),
    ("ugolok-gnut", ("уголки", "гнут"), ()),
    ("truba-kvadr", ("квадрат",), ("гнут", "замкн", "профил", "труб")),
    ("truba-pr", ("прямоуголь",), ("гнут", "замкн", "профил", "труб")),
    ("truba-ploskoval", ("плоскоовал",), ()),
    ("truba-vgp", ("водогазопровод",), ()),
    ("truba-vgp", ("вгп",), ()),
    ("balka", (), ("двутавр", "балк")),
    ("shveller", (), ("швеллер",)),
    ("ugolok", (), ("уголок", "уголки")),
    ("armatura", (), ("арматур",)),
    ("shestigrannik", (), ("шестигран",)),
)
STANDARD_RULES = (("balka", "57837"), ("balka", "26020"), ("balka", "8239"), ("balka", "асчм"), ("ugolok", "8509"), ("ugolok", "8510"), ("ugolok-gnut", "19771"), ("ugolok-gnut", "19772"), ("shveller", "8240"), ("shveller", "5267"), ("truba-kvadr", "30245"), ("truba-vgp", "3262"))
BEAM_MARK, CHANNEL_MARK = r"^[0-9]+(?:\.[0-9]+)?[БШКМД][0-9]*$", r"^[0-9]+(?:\.[0-9]+)?[ПУЭ]$"


def keywords(name: Column, counted: Sequence[str], excluded: Sequence[str]) -> Column:
    """counted, excluded, mixed, and the first counted keyword in list order."""
    n = F.lower(F.coalesce(name, F.lit("")))
    hit = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(n, w))
    yes, no = F.size(hit(counted)) > 0, F.size(hit(excluded)) > 0
    return F.struct(yes.alias("counted"), no.alias("excluded"), (yes & no).alias("mixed"), F.coalesce(F.get(hit(counted), F.lit(0)), F.lit("")).alias("matched"))


def category(name: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]], default: Column) -> Column:
    """The first rule whose words are all there, and one of its others if it has any."""
    n, out = F.lower(F.coalesce(name, F.lit(""))), default
    for slug, every, some in reversed(rules):
        good = F.lit(True)
        for w in every:
            good = good & F.contains(n, F.lit(w))
        if some:
            any_ = F.lit(False)
            for w in some:
                any_ = any_ | F.contains(n, F.lit(w))
            good = good & any_
        out = F.when(good, slug).otherwise(out)
    return out


def category_of_standard(standard: Column, rules: Sequence[tuple[str, str]] = STANDARD_RULES) -> Column:
    return category(standard, [(slug, (code,), ()) for slug, code in rules], F.lit(""))


def category_of_mark(mark: Column) -> Column:
    """Of a normalised mark, where its series letter alone tells; sizes do not."""
    return F.when(mark.rlike(BEAM_MARK), "balka").when(mark.rlike(CHANNEL_MARK), "shveller").otherwise("")


def resolved_category(name: Column, standard: Column, mark: Column) -> Column:
    """By the name of the group, else by the number of the standard, else by the mark's series; empty if none tells."""
    by_standard = category_of_standard(standard)
    return category(name, CATEGORY_RULES, F.when(by_standard != "", by_standard).otherwise(category_of_mark(mark)))


def status(is_sheet: Column, per_unit: Column, counted: Column, mixed: Column) -> Column:
    """A sheet is judged by its mass alone, before the keywords are."""
    none = F.coalesce(per_unit, F.lit(0.0)) <= 0
    return F.when(is_sheet & none, "no_data").when(is_sheet, "calculated").when(~counted, "excluded").when(none, "no_data").when(mixed, "needs_review").otherwise("calculated")


def facet_matches(value: Column, wanted: Column) -> Column:
    """Blank matches all on either side; a wanted value with `/` must match whole, another any part."""
    v, f = F.trim(F.coalesce(value, F.lit(""))), F.coalesce(wanted, F.lit(""))
    parts = F.transform(F.split(v, "/"), lambda x: F.trim(x))
    return (f == "") | (v == "") | F.when(F.contains(f, F.lit("/")), v == f).otherwise(F.array_contains(parts, f))


def search_rank(key: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 inside, else null."""
    k, q = F.upper(key), query.upper()
    return F.when(k == q, 0).when(k.startswith(q), 1).when(F.contains(k, F.lit(q)), 2)


def closest(word: Column, known: Sequence[str], most: int) -> Column:
    """Of known words the one that is fewest edits away, at most `most`; of equals the first."""
    best = F.array_min(F.array(*(F.struct(F.levenshtein(word, F.lit(w)).alias("d"), F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(known))))
    return F.when(best["d"] <= most, best["w"])
