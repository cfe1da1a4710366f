"""Rule-driven classifiers and text builders (F1-F8), as column expressions.

The rules are data (lists in :mod:`boxpace.config`); every function here turns
a list into one ordered ``CASE`` chain or map lookup that runs inside
whole-stage codegen. No Python runs per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, DEFAULT_CATEGORY, DEFAULT_EVENT_TYPE, WHITESPACE, PacingConfig

# Split point before every letter that follows a non-letter.
_WORD_START = r"(?<=[^\p{L}])(?=\p{L})"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Trim white space on both sides, as Python does (plain ``trim`` removes spaces only)."""
    return F.btrim(_c(x), F.lit(WHITESPACE))


def title_case(x) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest (F8).

    ``initcap`` only starts words after spaces; this one also after digits,
    hyphens and apostrophes: ``rock-n-roll o'neil 2nd`` -> ``Rock-N-Roll O'Neil 2Nd``.
    Text of letters and spaces only (the common case) takes ``initcap``, which
    gives the same result without the regex split.
    """
    x = _c(x)
    parts = F.split(F.lower(x), _WORD_START)
    general = F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
    return F.when(x.rlike(r"^[\p{L} ]*$"), F.initcap(x)).otherwise(general)


def _lookup(pairs, key: Column) -> Column:
    """Exact lookup in a literal map; NULL when the key is absent."""
    m = F.create_map(*[F.lit(x) for kv in dict(pairs).items() for x in kv])
    return F.try_element_at(m, key)


def first_substring_hit(pairs, text: Column) -> Column:
    """Value of the first (keyword, value) pair whose keyword occurs in ``text``."""
    expr = None
    for kw, val in pairs:
        cond = F.contains(text, F.lit(kw))
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr


def first_regex_hit(pairs, text: Column, default: str) -> Column:
    """Value of the first (pattern, value) pair whose regex matches ``text``."""
    expr = None
    for pat, val in pairs:
        cond = text.rlike(pat)
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.otherwise(F.lit(default))


def normalize_category(raw, fallback=None, cfg: PacingConfig = DEFAULT) -> Column:
    """Category normaliser (F1).

    A non-empty raw value: blank after trim -> default; exact (lower-case) map
    hit -> mapped; else the trimmed value in title case. An empty or NULL raw
    value falls back to the first keyword found in ``fallback``, else default.
    """
    raw_c = None if raw is None else _c(raw)
    cand = strip(raw_c) if raw_c is not None else None
    fb_expr = F.lit(DEFAULT_CATEGORY)
    if fallback is not None:
        fb_text = F.lower(strip(_c(fallback)))
        hit = first_substring_hit(cfg.category_map, fb_text)
        fb_expr = F.coalesce(hit, F.lit(DEFAULT_CATEGORY))
    if raw_c is None:
        return fb_expr
    raw_branch = (F.when(cand == "", F.lit(DEFAULT_CATEGORY))
                  .otherwise(F.coalesce(_lookup(cfg.category_map, F.lower(cand)), title_case(cand))))
    return F.when(raw_c.isNotNull() & (F.length(raw_c) > 0), raw_branch).otherwise(fb_expr)


def event_type(part=None, name="event_name", category=None, cfg: PacingConfig = DEFAULT) -> Column:
    """Event-type ladder.

    Non-blank part: series lookup -> first keyword in the part -> part in title
    case. Otherwise: first keyword in the name -> non-blank category -> 'Other'.
    """
    p = None if part is None else strip(_c(part))
    return event_type_of(p, None if p is None else F.lower(p), F.lower(F.coalesce(_c(name), F.lit(""))), category, cfg)


def event_type_of(p, key, name_text, category=None, cfg: PacingConfig = DEFAULT) -> Column:
    """:func:`event_type` of a trimmed part, its lower case and the name's.

    The ladder names each of them once per keyword: as columns of their own they are built once per row.
    """
    by_name = first_substring_hit(cfg.keyword_types, _c(name_text))
    cat_branch = F.lit(DEFAULT_EVENT_TYPE)
    if category is not None:
        cat = strip(_c(category))
        cat_branch = F.when(cat.isNotNull() & (cat != ""), cat).otherwise(F.lit(DEFAULT_EVENT_TYPE))
    no_part = F.coalesce(by_name, cat_branch)
    if p is None:
        return no_part
    p, key = _c(p), _c(key)
    with_part = F.coalesce(_lookup(cfg.series_lookup, key),
                           first_substring_hit(cfg.keyword_types, key),
                           title_case(p))
    return F.when(p.isNotNull() & (p != ""), with_part).otherwise(no_part)


def collab_category(name="event_name", cfg: PacingConfig = DEFAULT) -> Column:
    """Regex categoriser of event names, first match wins."""
    text = F.lower(F.coalesce(_c(name), F.lit("")))
    return first_regex_hit(cfg.collab_patterns, text, DEFAULT_CATEGORY)


def label_event_type(event_type_col, event_part_col, has_event_type: Column | None) -> Column:
    """event_type when the column has any value, else event_part, else 'Other' (F5)."""
    et = F.coalesce(event_type_col, F.lit("Other")) if event_type_col is not None else None
    ep = F.coalesce(event_part_col, F.lit("Other")) if event_part_col is not None else None
    if et is not None and ep is not None:
        return F.when(has_event_type, et).otherwise(ep)
    if et is not None:
        return F.when(has_event_type, et).otherwise(F.lit("Other"))
    if ep is not None:
        return ep
    return F.lit("Other")


def event_label(name="event_name", part=None) -> Column:
    """Name, plus ' – part' when the part is not blank; NULL name -> 'Unknown' (F6)."""
    base = strip(F.coalesce(_c(name), F.lit("Unknown")))
    if part is None:
        return base
    p = strip(F.coalesce(_c(part), F.lit("")))
    return F.when(p == "", base).otherwise(F.concat(base, F.lit(" – "), p))


def event_instance(label="event_label", event_date="event_date") -> Column:
    """lower(label) | yyyy-MM-dd, with 'unknown' for NULL parts."""
    lab = F.coalesce(strip(F.lower(_c(label))), F.lit("unknown"))
    day = F.coalesce(F.date_format(_c(event_date), "yyyy-MM-dd"), F.lit("unknown"))
    return F.concat(lab, F.lit("|"), day)
