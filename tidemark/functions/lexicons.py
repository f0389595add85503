"""Word lists and patterns.  Every list is a default of some function's argument."""

from __future__ import annotations

from dataclasses import dataclass, field

ASPECTS = ("guidance", "margins", "demand", "litigation", "management_tone", "liquidity")
LABELS = ("negative", "neutral", "positive")

# These lists decide results and equal the published defaults.
NEGATION_CUES = (
    "not no never without cannot neither nor none nothing unable hardly barely n't isn't aren't wasn't weren't don't "
    "doesn't didn't won't wouldn't can't couldn't shouldn't haven't hasn't lack lacks lacking absent"
).split()
CLAUSE_BREAKS = [",", ";", ":", ".", "!", "?", *"but although though however while whereas except".split()]
NEGATION_WINDOW = 4
HEDGE_WORDS = (
    "may might could would should possibly perhaps potentially probably believe believes expect expects anticipate "
    "anticipates hope hopefully approximately around roughly somewhat modestly limited uncertain uncertainty depends "
    "depending subject likely unlikely appear appears suggest suggests seem seems difficult hard unclear visibility"
).split()
CONTRAST = "but although though however whereas while yet".split()
ABBREVIATIONS = "mr mrs ms dr inc corp co ltd vs etc u.s e.g i.e no fy q1 q2 q3 q4 approx est st jr sr".split()

ASPECT_TERMS: dict[str, list[str]] = {
    "guidance": [
        "guidance", "outlook", "forecast", "full-year", "full year", "annual guidance", "we expect revenue", "we expect", "expect revenue",
        "reiterat*", "raising our", "lowering our", "maintaining our", "target range", "visibility", "second half", "next few quarters",
    ],
    "margins": [
        "gross margin", "operating margin", "ebitda margin", "net margin", "margin", "margins", "profitability", "input cost", "input costs",
        "cost base", "cost inflation", "pricing", "productivity", "operating leverage", "compute costs", "costs", "tariff", "tariffs",
    ],
    "demand": [
        "demand", "orders", "order backlog", "backlog", "bookings", "pipeline", "sales cycle", "sales cycles", "deal cycles",
        "net revenue retention", "net retention", "churn", "retention", "revenue", "subscription revenue", "volumes", "customers", "customer",
    ],
    "litigation": [
        "litigation", "lawsuit", "patent", "dispute", "legal", "regulatory", "settlement", "investigation", "defendant", "infringement",
        "material charge", "adverse outcome", "class action", "lawsuits", "legal matters",
    ],
    "management_tone": [
        "confident", "confidence", "optimistic", "cautious", "comfortable", "pleased", "concerned", "uncertain", "uncertainty", "we believe",
        "management team", "management is", "monitoring it", "difficult to predict", "hard to say", "difficult to say", "not able to say",
        "unable to", "not comfortable", "excited", "disappointed",
    ],
    "liquidity": [
        "liquidity", "cash", "free cash flow", "debt", "revolver", "revolving credit facility", "credit facility", "leverage", "covenant",
        "covenants", "working capital", "balance sheet", "cash equivalents", "borrowings", "credit agreement", "leverage ratio",
    ],
}

NEGATIVE = (
    "adverse adversely against impairment impaired weak weaker weakness weakened weaken loss losses decline declined declines declining "
    "deteriorate deteriorated deterioration shortfall shortfalls default defaults delay delayed delays disappointing disappointed disruption "
    "disruptions failure failures fail failed headwind headwinds inability unable unfavorable underperform underperformed volatile volatility "
    "worsen worsened worse concern concerned concerns cut cuts downturn restructuring writedown writeoff suffered suffer severe pressure "
    "pressures challenging challenges difficult difficulty negative negatively penalty penalties recall shortage slowdown slowing softness "
    "soft adversary burden curtail damage damages deficit detriment erode eroded erosion hurt inferior lawsuit lawsuits lower lowered lowering "
    "poor problem problems reduced reduction risk risks slump strain stress subpoena tighter tighten unfavorably withdraw withdrawn "
    "withdrawing withdrawal misstatement fraud bankruptcy insolvency downgrade downgraded"
).split()
POSITIVE = (
    "strong stronger strength strengthen strengthened record improve improved improvement improving improvements gain gains growth grew robust "
    "outperform outperformed exceed exceeded exceeding favorable favorably beat confident confidence optimistic excellent efficient "
    "efficiencies efficiency profitable profitability opportunity opportunities success successful successfully accelerate accelerated "
    "accelerating achieve achieved attractive benefit benefits benefited best better boost boosted breakthrough enhance enhanced encouraged "
    "encouraging excited expand expanded expansion highest leading lucrative momentum pleased positive positively resilient resilience rebound "
    "solid superior surpass surpassed upside upgrade upgraded win wins won healthy strongest"
).split()
UNCERTAINTY = (
    "may might could possibly perhaps uncertain uncertainty uncertainties unclear approximately assume assumes assumption believe believes "
    "depend depends depending fluctuate fluctuations indefinite likelihood probable probably risk risks unknown unpredictable variability "
    "volatile volatility visibility hard difficult anticipate estimate estimates contingent exposure hope hopefully roughly somewhat unable"
).split()
LITIGIOUS = [
    *(
        "litigation lawsuit lawsuits court plaintiff defendant settlement verdict appeal arbitration subpoena injunction infringement patent "
        "patents legal attorney jury regulator regulatory investigation indictment sued sue trial judgment dispute disputes allegation "
        "allegations complaint claims"
    ).split(),
    "class action",
]
UP = (
    "increase increased increases increasing rose rise rising risen grew grow growth growing climbed climb expanded expand expansion jumped "
    "higher up surged accelerated raise raised raising lift lifted lifting lengthened elevated outpacing outpaced added"
).split()
DOWN = (
    "decrease decreased decreases decreasing fell fall falling declined decline declining dropped drop shrank contracted contract lower lowered "
    "lowering reduced reduce reducing reduction down slipped cut cuts cutting eased narrowed shrinking tighter"
).split()
BAD_WHEN_UP = (
    r"costs?|expenses?|expense|debt|leverage|borrowings?|churn|cancellations?|liabilit(?:y|ies)|litigation|lawsuits?|legal|tariffs?|inflation|"
    r"maturities|interest|cycles?|delays?|losses|loss|scrutiny|exposure|provisions?|charges?|working capital|days"
)
GOOD_WHEN_UP = "cash conversion|cash|headroom|availability|liquidity"
NEGATIVE_EVENTS = (
    r"named as a defendant|subpoena|adverse (?:outcome|ruling)|material charge|verdict went against|unable to (?:say|quantify|provide|predict)|"
    r"not (?:able|comfortable)|difficult to (?:predict|say)|hard to say|no longer expect|failure to comply|drew|fully drew|withdraw\w*"
)
POSITIVE_EVENTS = (
    r"dismissed|favorable settlement|in (?:our|its) favor|closed (?:without|with no)|no findings|no debt|undrawn|"
    r"record (?:high|free cash flow|backlog)|above (?:our|the) (?:prior|top)|resolved (?:the|earlier)|below the low end of our prior"
)
QA_MARKERS = (
    r"question[\s\-]*and[\s\-]*answer|q\s*&\s*a\s+session|open (?:it )?up (?:the line|for questions)|first question (?:comes|is) from|"
    r"we will now begin the question"
)
QUESTION_INTRO = (
    r"(?:first|next|following|last|final) question|question (?:comes|is coming) from|from the line of|(?:your|the) line is (?:now )?open|"
    r"question-and-answer session|q\s*&\s*a (?:session|portion)|^\W*operator instructions\W*$"
)
HANDOFF = (
    r"open (?:it |this |the (?:call|line|floor) )?(?:up )?(?:for|to) (?:your )?questions|(?:take|begin|start) (?:your |some |the )?questions|"
    r"(?:move|go|turn it|turn the call|hand it|over) (?:on |back |over )?to (?:the )?(?:q\s*&\s*a|questions)"
)
OPERATOR_NAMES = ["operator", "moderator", "conference operator", "coordinator"]
STOP_WORDS = (
    "the and for with that this from are was were our its has have had not but will would could may can into over than then also management "
    "said supportive concerning guidance margins demand litigation liquidity tone"
).split()
EMBED_STOP = "the a an of and to in on for is are was were we our that this it as at by be with from has have had".split()
NEGATIVE_CUES = (
    r"not|no|cannot|unable|fail\w*|declin\w*|decreas\w*|fell|lower\w*|weak\w*|pressure|headwind\w*|adverse|difficult|cut|cutting|withdraw\w*|"
    r"unfavorable|contract\w*|deteriorat\w*|softness|delay\w*|churn"
)
POSITIVE_CUES = (
    r"strong|record|grew|growth|increas\w*|expand\w*|improv\w*|rais\w*|robust|healthy|confident|optimistic|exceed\w*|favorable|no debt|undrawn|"
    r"gain\w*|accelerat\w*"
)
FLIPS = [
    ("expanded", "contracted"), ("improved", "deteriorated"), ("raising", "cutting"), ("raised", "lowered"), ("increased", "decreased"),
    ("grew", "shrank"), ("strong", "weak"), ("record", "declining"), ("confident", "concerned"), ("healthy", "deteriorating"),
    ("lowered", "raised"), ("fell", "rose"), ("declined", "increased"), ("contracted", "expanded"), ("lower", "higher"), ("weak", "strong"),
]


@dataclass(frozen=True)
class Lexicon:
    """All lists that aspect detection and polarity read."""

    terms: dict[str, list[str]] = field(default_factory=lambda: ASPECT_TERMS)
    positive: list[str] = field(default_factory=lambda: POSITIVE)
    negative: list[str] = field(default_factory=lambda: NEGATIVE)
    uncertainty: list[str] = field(default_factory=lambda: UNCERTAINTY)
    litigious: list[str] = field(default_factory=lambda: LITIGIOUS)
    up: list[str] = field(default_factory=lambda: UP)
    down: list[str] = field(default_factory=lambda: DOWN)
    cues: list[str] = field(default_factory=lambda: NEGATION_CUES)
    breaks: list[str] = field(default_factory=lambda: CLAUSE_BREAKS)
    hedges: list[str] = field(default_factory=lambda: HEDGE_WORDS)
    contrast: list[str] = field(default_factory=lambda: CONTRAST)
    bad_when_up: str = BAD_WHEN_UP
    good_when_up: str = GOOD_WHEN_UP


FINANCE = Lexicon()


def term_pattern(terms: list[str]) -> str:
    """One alternation per aspect, longest term first: the leftmost match is the
    earliest mention and, among those that start there, the longest.  A final *
    stands for any further word characters."""
    regex = {"-": r"\-"}
    one = lambda t: "".join(regex.get(c, c) for c in t.rstrip("*")) + (r"\w*" if t.endswith("*") else r"\b")
    return r"\b(?:" + "|".join(one(t) for t in sorted(terms, key=len, reverse=True)) + ")"
