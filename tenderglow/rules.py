"""Fixed values and the rule sets built from them.

Everything an operator matches against is a field of one of these frozen
dataclasses, so a caller can run the same job with another vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: procedural states, novelty, levels --------------------------------------

PRE_TENDER = "PRE-GARA"
PUBLISHED = "GARA PUBBLICATA"
AMENDED = "RETTIFICA-PROROGA-CHIARIMENTI"
OUTCOME = "ESITO-AGGIUDICAZIONE-VARIANTE-REVOCA"
STATES = (PRE_TENDER, PUBLISHED, AMENDED, OUTCOME)

NEW_TODAY = "Nuovo oggi"
SURFACED_TODAY = "Nuovo emerso oggi ma pubblicato prima"
KNOWN_UPDATE = "Aggiornamento gara nota"
PRE_TENDER_SIGNAL = "Segnale pre-gara"
NOVELTIES = (NEW_TODAY, SURFACED_TODAY, KNOWN_UPDATE, PRE_TENDER_SIGNAL)

YES, NO = "Yes", "No"
UNKNOWN_RANK = 999
SECTOR = "Illuminazione pubblica"
NO_BUYER = "n.d."
# Texts that mean "no value" in amounts and dates.
NOT_DISCLOSED = ("n.d.", "nd", "na", "n/a")

# ---- fixed values: scope ----------------------------------------------------------------------

SCOPE_INCLUDE = (
    "illuminazione pubblica",
    "pubblica illuminazione",
    "relamping",
    "telegestione",
    "telecontrollo",
    "smart lighting",
    "riqualificazione illuminazione",
    "pali illuminazione",
    "pali di illuminazione",
    "global service illuminazione",
    "accordo quadro illuminazione",
    "servizio luce",
    "illuminazione stradale",
)
SCOPE_EXCLUDE = (
    "illuminazione interna",
    "impianto elettrico generico",
    "facility management",
    "climatizzazione",
    "edifici",
    "immobili",
    "fotovoltaico senza ip",
)
SCOPE_CODES = (
    "31518200",
    "31520000",
    "31521000",
    "31527200",
    "31527260",
    "34928510",
    "34993000",
    "45316100",
    "45316110",
    "50232000",
    "50232100",
    "71323100",
    "71323200",
)
# The notice service is asked for these four codes only.
NOTICE_CODES = ("34928510", "34993000", "50232000", "45316110")
# Buyer country asked for, and days looked back without a date of its own: current layout, older layout.
NOTICE_COUNTRY = "ITA"
NOTICE_DAYS = 14
OLD_NOTICE_COUNTRY = "IT"
OLD_NOTICE_DAYS = 7
# A framework lot is kept when its names contain one of these.
LOT_KEYWORDS = ("illuminazione", "servizio luce", "efficientamento energetico degli impianti")
# Anchor texts that lead to the tenders section of a transparency page.
SECTION_LINK_TEXTS = (
    "bandi di gara e contratti",
    "bandi di gara",
    "bandi gara e contratti",
    "bandi gara contratti",
)

# ---- fixed values: identifiers ----------------------------------------------------------------

CIG_PATTERN = r"^[A-Z0-9]{8,10}$"
CUP_PATTERN = r"^[A-Z][0-9]{14}[A-Z0-9]$"

# ---- fixed values: tag, flag and state patterns (matched without regard to case) --------------

TAG_PATTERNS = (
    ("LED", r"\b(led|relamp)\b"),
    ("telegestione", r"telegest"),
    ("telecontrollo", r"telecontr"),
    ("smart lighting", r"smart[\s-]?light"),
    ("global service", r"global[\s-]?serv"),
    ("accordo quadro", r"accordo[\s-]?quad"),
    ("manutenzione", r"manuten|gestione"),
    ("proroga", r"proroga"),
    ("semafori accorpati", r"semafor[ioci]|impianti\s+semaforic"),
    ("PNRR", r"pnrr|pnc|react[\s.\-]?eu"),
    ("PPP", r"\bppp\b|concessione|project[\s.\-]?fin"),
)
EU_THRESHOLD_TAG = "sopra soglia UE"
EU_THRESHOLD = 5_538_000

FLAG_PATTERNS = (
    ("flag_ppp_doppio_oggetto", r"\bppp\b|project[\s.\-]?fin|concessione"),
    ("flag_concessione_ambito", r"concessione|affidament[oa]\s+concessione"),
    ("flag_in_house_ambito", r"in\s*house"),
    ("flag_om", r"manutenzione|global\s+service|gestione\s+impianti|o\s*&\s*m|servizio\s+luce"),
    (
        "flag_pre_gara",
        r"delibera|determin[ae]|avviso\s+preinformazione"
        r"|manifestazione\s+d['’]?interesse|indagine\s+di\s+mercato",
    ),
)
FLAGS = tuple(name for name, _ in FLAG_PATTERNS)

OUTCOME_PATTERN = r"esito|aggiudic|revoca|deserta|annullat"
AMENDED_PATTERN = r"proroga|rettifica|chiariment"
PRE_TENDER_PATTERN = (
    r"delibera|determin[ae]|manifestazione\s+d['’]?interesse|avviso\s+preinformazione"
)
# An act of this type does not by itself make a notice a pre-tender signal.
NEWS_ACT = "notizia"

FRAMEWORK_INSTRUMENTS = ("accordo quadro", "convenzione", "sistema dinamico di acquisizione", "sda")

# ---- fixed values: keys looked up in extracted_json, first usable wins --------------------------

DESCRIPTION_KEYS = ("oggetto", "titolo", "descrizione")
BUYER_KEYS = ("ente", "stazione_appaltante", "amministrazione", "buyer")
LATE_BUYER_KEYS = ("amministrazione_titolare", "buyer_name_1")
CIG_KEYS = ("cig", "cig_raw")
AMOUNT_KEYS = ("importo", "importo_raw", "valore", "total_value")
PUBLISHED_KEYS = ("data_pubblicazione", "data_pub", "pub_date")
DEADLINE_KEYS = ("scadenza", "scadenza_raw", "deadline")
PROCEDURE_KEYS = ("procedura", "procedura_raw", "tipo_procedura")

# ---- fixed values: scoring ----------------------------------------------------------------------

# (value must exceed, points); the remainder gets AMOUNT_FLOOR_POINTS.
AMOUNT_BANDS = (
    (10_000_000, 35),
    (5_000_000, 28),
    (2_000_000, 20),
    (1_000_000, 14),
    (500_000, 8),
)
AMOUNT_FLOOR_POINTS = 3
# (at most this many days, points)
DEADLINE_BANDS = ((3, 20), (7, 15), (15, 10), (30, 5))


@dataclass(frozen=True)
class ScopeRules:
    include: tuple[str, ...] = SCOPE_INCLUDE
    exclude: tuple[str, ...] = SCOPE_EXCLUDE
    codes: tuple[str, ...] = SCOPE_CODES
    include_points: int = 2
    exclude_points: int = -3
    code_points: int = 2
    threshold: int = 1


@dataclass(frozen=True)
class TagRules:
    patterns: tuple[tuple[str, str], ...] = TAG_PATTERNS
    threshold_tag: str = EU_THRESHOLD_TAG
    threshold: int = EU_THRESHOLD

    @property
    def vocabulary(self) -> tuple[str, ...]:
        return tuple(label for label, _ in self.patterns) + (self.threshold_tag,)


@dataclass(frozen=True)
class StateRules:
    outcome: str = OUTCOME_PATTERN
    amended: str = AMENDED_PATTERN
    pre_tender: str = PRE_TENDER_PATTERN
    news_act: str = NEWS_ACT


@dataclass(frozen=True)
class ScoreRules:
    amount_bands: tuple[tuple[int, int], ...] = AMOUNT_BANDS
    amount_floor: int = AMOUNT_FLOOR_POINTS
    published: int = 25
    amended: int = 20
    pre_tender_strong: int = 20
    pre_tender_weak: int = 8
    outcome: int = 10
    deadline_bands: tuple[tuple[int, int], ...] = DEADLINE_BANDS
    ppp: int = 8
    pnrr: int = 6
    eu_threshold: int = 4
    framework: int = 3
    framework_words: tuple[str, ...] = ("accordo", "global")
    strong_words: tuple[str, ...] = ("delibera", "determina", "avviso preinformazione")
    p1_score: int = 70
    p1_amount: int = 5_000_000
    p1_days: int = 2
    p2_score: int = 50
    p3_score: int = 30


@dataclass(frozen=True)
class AnomalyRules:
    repeated_type: str = "proroga"
    repeated_min: int = 2
    repeated_days: int = 30
    revoked_type: str = "revoca"
    appeal_type_words: tuple[str, ...] = ("ricorso", "tar")
    appeal_text_words: tuple[str, ...] = ("ricorso", "tar ")
    bridge_words: tuple[str, ...] = ("ponte", "deserta", "a seguito di revoca")
    stalled_days: int = 14


@dataclass(frozen=True)
class NormaliseRules:
    scope: ScopeRules = ScopeRules()
    tags: TagRules = TagRules()
    flags: tuple[tuple[str, str], ...] = FLAG_PATTERNS
    state: StateRules = StateRules()
    frameworks: tuple[str, ...] = FRAMEWORK_INSTRUMENTS
    sector: str = SECTOR
