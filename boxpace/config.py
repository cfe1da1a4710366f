"""Configuration and rule sets.

Every operator takes a :class:`PacingConfig`; nothing reads module globals at
run time, so a user can override any threshold, date or rule list per call.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source application's rule tables and
# constants so that classifications, buckets and labels come out the same.
# They are listed as text, in their natural order.
# ---------------------------------------------------------------------------

# Category normaliser: exact lookup of the lower-cased value; the same pairs,
# in this order, are the substring keywords of the name fallback.
CATEGORY_MAP: tuple[tuple[str, str], ...] = (
    ("musical", "Theatre"),
    ("musicals", "Theatre"),
    ("opera", "Theatre"),
    ("ballet", "Theatre"),
    ("theatre", "Theatre"),
    ("play", "Theatre"),
    ("talk", "Talks"),
    ("lecture", "Talks"),
    ("panel", "Talks"),
    ("concert", "Concerts"),
    ("orchestra", "Concerts"),
    ("symphony", "Concerts"),
    ("choir", "Concerts"),
    ("chorus", "Concerts"),
    ("festival", "Festivals"),
    ("film", "Film"),
)
DEFAULT_CATEGORY = "Other (Unmapped)"

# Event-type ladder: exact series lookup on the part, then ordered keywords.
SERIES_LOOKUP: tuple[tuple[str, str], ...] = (
    ("gala", "Gala"),
    ("chamber", "Chamber Series"),
    ("dance", "Dance Series"),
    ("family", "Family Series"),
    ("lecture", "Lecture Series"),
    ("opera", "Opera Series"),
    ("symphony", "Symphony Series"),
    ("ballet", "Ballet Series"),
)
KEYWORD_TYPE_MAP: tuple[tuple[str, str], ...] = (
    ("symphony", "Symphony Orchestra"),
    ("orchestra", "Symphony Orchestra"),
    ("choir", "Choir / Vocal"),
    ("chorus", "Choir / Vocal"),
    ("glee", "Choir / Vocal"),
    ("opera", "Opera"),
    ("ballet", "Ballet"),
    ("dance", "Dance"),
    ("jazz", "Jazz"),
    ("recital", "Recital"),
    ("talk", "Talk / Lecture"),
    ("lecture", "Talk / Lecture"),
    ("festival", "Festival"),
    ("film", "Film / Screening"),
)
DEFAULT_EVENT_TYPE = "Other"
MISSING_EVENT_TYPE = "Other/Unknown"

# Regex categoriser for the period comparison: first match wins.
COLLAB_PATTERNS: tuple[tuple[str, str], ...] = (
    (r"(theat(er|re)|play|drama|musical|opera|operetta|ballet|nutcracker)", "Theatre"),
    (r"(symph(ony|onic)|philharm|orchestra|concerto|chamber|baroque|quartet|classical)", "Music—Classical"),
    (r"jazz", "Music—Jazz"),
    (r"(rock|pop|folk|indie|singer[- ]songwriter)", "Music—Folk/Rock/Pop"),
    (r"(family|kids|children|youth|junior)", "Family Fun"),
    (r"\bdance\b", "Dance"),
    (r"circus", "Circus Arts"),
    (r"(lecture|talk|exhibit|symposium)", "Lecture/Exhibit"),
    (r"(festival|series|gala|residency|workshop|special)", "Special Programs"),
    (r"world|global|international|afro|latin|celtic|klezmer|tabla|sitar", "World/Global"),
    (r"\bmusic\b", "Music"),
)

# Lead buckets, closed ranges (share-of-weekday heatmap).
LEAD_BUCKETS_CLOSED: tuple[tuple[int, int, str], ...] = (
    (0, 7, "0-7"),
    (8, 14, "8-14"),
    (15, 30, "15-30"),
    (31, 60, "31-60"),
    (61, 120, "61-120"),
)
# Lead buckets, right-closed intervals over these edges (share-of-total heatmap).
LEAD_EDGES_HALF_OPEN: tuple[int, ...] = (-1, 7, 14, 30, 60, 90, 120)
LEAD_LABELS_HALF_OPEN: tuple[str, ...] = ("0–7", "8–14", "15–30", "31–60", "61–90", "91–120")

WEEKDAYS: tuple[str, ...] = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Cohort tiers, most specific first, and their display labels.
COHORT_TIERS: tuple[tuple[str, ...], ...] = (
    ("event_type", "weekday", "venue"),
    ("event_type", "weekday"),
    ("event_type",),
    (),
)
TIER_LABELS: dict[str, str] = {
    "event_type|weekday|venue": "Type+Weekday+Venue",
    "event_type|weekday": "Type+Weekday",
    "event_type": "Type only",
    "all": "All events (global)",
}

STATUS_BEHIND = "Behind"
STATUS_AHEAD = "Ahead"
STATUS_ON_PACE = "On pace"
STATUS_NONE = "No benchmark"
STATUS_TEXT_MAP: tuple[tuple[str, str], ...] = (("behind", "Behind"), ("on pace", "On pace"), ("ahead", "Ahead"))

PRE_LABEL = "Pre-COVID"
POST_LABEL = "Post-COVID"
BASELINE_GLOBAL_LABEL = "all events (global)"
BASELINE_TYPE_LABEL = "event type only"

REQUIRED_COLUMNS: tuple[str, ...] = ("sale_date", "event_date", "event_name", "qty_sold")
NUMERIC_COLUMNS: tuple[str, ...] = ("qty_sold", "amount")
# Characters Python's str.strip() removes.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
              + "\u2028\u2029\u202f\u205f\u3000")
# Tokens read as missing in CSV input (pandas' default list).
CSV_NULL_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Plain decimal numbers.
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Names of months and weekdays in texts of dates, by their first three letters (English).
MONTHS: tuple[str, ...] = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE_MONTH = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\b"
DATE_WEEKDAY = r"\b(mon|tues?|wed|thu|thurs?|fri|sat|sun)(day|nesday|rsday|urday|sday)?\b"
# Two-digit years from this one on are of the last century.
CENTURY_PIVOT = 70


@dataclass(frozen=True)
class PacingConfig:
    """Thresholds, dates and rule sets of every operator (defaults = source app)."""

    max_lead: int = 120
    bin_size: int = 3
    band_pp: float = 5.0
    min_cohort: int = 20
    hide_soldout_at: float = 98.0
    watch_top_n: int = 50
    tiers: tuple[tuple[str, ...], ...] = COHORT_TIERS
    pre_end: dt.date = dt.date(2020, 3, 1)
    post_start: dt.date = dt.date(2021, 7, 1)
    period_split: dt.date = dt.date(2021, 7, 1)
    min_events_baseline: int = 25
    top_k_types: int = 12
    top_categories: int = 6
    top_events: int = 12
    heat_min_names: int = 20
    heat_min_rows: int = 500
    current_min_events: int = 3
    checkpoint_days: tuple[int, ...] = (30, 7)
    checkpoint_tol: int = 5
    share_min_other: float = 0.05
    # Columns that fix the order of sales with equal days_out (running sums
    # depend on it). A missing column is an error; sale_date always comes first.
    order_key: tuple[str, ...] = ("sale_seq",)
    # Sales of one minute are summed in stretches of this many values of the first order column.
    order_span: int = 1 << 20
    # What an event of the watchlist's library is: its name (sales of all its dates together) or "event_instance" (label and date).
    event_key: str = "event_name"
    # Leave sales after the as-of day out of the watchlist; by default they count, as in the source.
    strict_as_of: bool = False
    # Exact quantiles by default; a positive value switches to percentile_approx.
    approx_accuracy: int = 0
    category_map: tuple[tuple[str, str], ...] = CATEGORY_MAP
    series_lookup: tuple[tuple[str, str], ...] = SERIES_LOOKUP
    keyword_types: tuple[tuple[str, str], ...] = KEYWORD_TYPE_MAP
    collab_patterns: tuple[tuple[str, str], ...] = COLLAB_PATTERNS
    lead_buckets: tuple[tuple[int, int, str], ...] = LEAD_BUCKETS_CLOSED
    lead_edges: tuple[int, ...] = LEAD_EDGES_HALF_OPEN
    lead_labels: tuple[str, ...] = LEAD_LABELS_HALF_OPEN

    def with_(self, **kw) -> "PacingConfig":
        return replace(self, **kw)

    @property
    def bins(self) -> list[int]:
        return list(range(0, self.max_lead + 1, self.bin_size))


DEFAULT = PacingConfig()


def tier_name(keys: tuple[str, ...]) -> str:
    return "|".join(keys) if keys else "all"
