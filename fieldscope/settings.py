"""Parameters of the radar: term model, workstreams, thresholds, weights.

These are small, hand-written configuration lists.  They enter plans as
literals, so nothing here grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TermModel:
    """Term lists.  Terms match as case-insensitive substrings; a term listed
    twice counts twice and blank terms are ignored."""

    topic: tuple[str, ...] = ()
    region: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: dict) -> "TermModel":
        return cls(
            topic=tuple(raw.get("topic") or ()),
            region=tuple(raw.get("region") or ()),
            exclude=tuple(raw.get("exclude") or ()),
            tags={k: tuple(v or ()) for k, v in (raw.get("tags") or {}).items()},
        )

    def terms(self):
        """Every listed term as (kind, tag, term), in configuration order."""
        for kind in ("topic", "region", "exclude"):
            for term in getattr(self, kind):
                yield kind, "", term
        for tag, terms in self.tags.items():
            for term in terms:
                yield "tag", tag, term


@dataclass(frozen=True)
class VenueWeights:
    """Score nudge for where a paper appeared."""

    enabled: bool = True
    peer_reviewed: int = 1
    preprint: int = -1
    no_abstract_offset: int = 1


@dataclass(frozen=True)
class Workstream:
    tag: str
    label: str
    color: str


@dataclass(frozen=True)
class ReportSettings:
    show_threshold: int = 6
    highlight_threshold: int = 8
    render_days: int = 14
    top_hours: int = 48
    listing_limit: int = 300
    top_limit: int = 8
    digest_min_score: int | None = None
    digest_hours: int = 36
    library_every_days: int = 7
    library_top_n: int = 30

    @property
    def digest_floor(self) -> int:
        """Digest floor; an unset or zero value falls back to the listing floor."""
        return int(self.digest_min_score or self.show_threshold)


@dataclass(frozen=True)
class DiscoverySettings:
    discovery_days: int = 120
    max_authors: int = 15
    max_seed_works: int | None = None


# Labels, limits and colours that results must carry unchanged.
NO_TAG = "none"
OTHER_LABEL = "Other"
DEFAULT_COLOR = "#888888"
SCORE_MIN, SCORE_MAX = 0, 10
TAG_WEIGHT = 3
BATCH_SIZE = 20
FAILURE_STREAK = 3
UNTITLED = "(untitled)"
QUERY_LABEL = "openalex:"
ISSN_LABEL = "openalex:issn:"
WATCHED_AUTHOR_LABEL = "openalex:author:"
NEWS_LABEL = "gnews:"
PREPRINT_SOURCE = "arxiv"
PREPRINT_VENUE = "arXiv"
FEED_LABEL = "rss:"
NO_ABSTRACT_NOTE = "no abstract available from the source; judge on title and venue"
CITES_LABEL = "library: cites your library"
AUTHOR_LABEL = "library: author you read"
DEFAULT_PREPRINT_CATEGORY = "eess.SY"
HEADLINE_LIMIT = 40
WINDOW_DAYS = 7
KEEP_ITEM_DAYS = 180
KEEP_RUN_DAYS = 30

# The workstreams of the seed configuration, in report order.
DEFAULT_WORKSTREAMS = (
    Workstream("chapter3", "chapter3", "#0077BB"),
    Workstream("power-market-reform", "Power Market Reform", "#33BBEE"),
    Workstream("captive-coal", "Captive coal", "#CC3311"),
    Workstream("apg-regional", "ASEAN Power Grid", "#009988"),
    Workstream("stakeholder", "Stakeholder intel", "#EE7733"),
    Workstream("methods", "Methods & tools", "#EE3377"),
)

# The term lists of the seed configuration.
DEFAULT_TERMS = TermModel(
    topic=("power system", "power sector", "electricity", "grid", "transmission", "dispatch",
           "capacity expansion", "unit commitment", "renewable", "solar", "wind", "coal",
           "captive", "smelter", "nickel", "interconnection", "tariff", "unbundling",
           "decarbonization", "energy transition", "PLN", "RUPTL", "PDP8", "MILP",
           "optimization", "JuMP"),
    region=("indonesia", "vietnam", "malaysia", "singapore", "philippines", "asean",
            "southeast asia", "emerging asia", "java", "sumatra", "sulawesi", "kalimantan",
            "china", "india"),
    exclude=("horoscope", "celebrity", "recipe", "football", "cryptocurrency"),
    tags={
        "chapter3": ("pln", "ruptl", "java-bali", "sumatra", "sulawesi", "kalimantan",
                     "inter-island", "super grid", "indonesia grid", "indonesia power"),
        "power-market-reform": ("market reform", "unbundling", "dispatch reform", "tariff",
                                "pricing", "regulator", "pdp8", "discom", "provincial pilot",
                                "electricity market"),
        "captive-coal": ("captive", "captive coal", "nickel", "smelter", "imip", "iwip",
                         "industrial park", "industrial ppa", "off-grid industrial"),
        "apg-regional": ("asean power grid", "ltms", "subsea cable", "interconnector",
                         "cross-border", "singapore import", "bilateral"),
        "stakeholder": ("pln", "memr", "esdm", "evn", "moit", "tnb", "jetp", "etp",
                        "adb energy", "iesr", "wri", "appointed", "leadership", "budget"),
        "methods": ("unit commitment", "expansion planning", "decomposition", "benders",
                    "stochastic", "open model", "optimization", "milp", "julia", "jump",
                    "solver"),
    },
)
