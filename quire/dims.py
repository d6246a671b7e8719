"""Small reference dimensions: document classes, field schemas, stages, languages.

Everything here is configuration of a known, small size (a taxonomy has tens of
classes, never rows that grow with the data), so it may be broadcast or inlined as
literals. ``Taxonomy.load`` reads a user's own taxonomy from JSON.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TAXONOMY_TERMS = 50_000

# --- fixed values -------------------------------------------------------------
# These must equal the published behaviour for results to match.

STAGES = ["enhancement", "ocr", "doc_class", "index_genius", "abstractor", "lingua"]

STAGE_STATUS_FINISHED = ["qc_pending", "approved", "rejected"]

CLASS_PROTOTYPES = {
    "Gazette": "gazette mizoram government extraordinary general zoram hriattima volume vol no notification "
    "published authority part section ordinance rule regulation issue weekly daily public notice "
    "proclamation appointment transfer department ministry",
    "Proceedings": "proceedings legislative assembly session house mr speaker hon ble member chair sitting debate "
    "question hour zero hour matter raised verbatim record official report shri smt government "
    "opposition bench reply minister",
    "Budget Speech": "budget speech finance minister presenting estimates revenue expenditure capital plan annual "
    "fiscal year deficit grants appropriation tax proposal scheme allocation outlay direct indirect "
    "treasury vote on account",
    "Bulletin": "bulletin part i ii iii summary day proceedings business transacted notice committee meeting "
    "publication legislative assembly secretary ordered printed reference daily",
    "Calendar": "calendar of sittings session legislative assembly programme schedule dates from to monday "
    "tuesday wednesday thursday friday saturday holiday recess working days roster",
    "List Of Business": "list of business friday monday tuesday wednesday thursday assembly session presentation papers "
    "questions oral written motion bill resolution adjournment introduction obituary statement "
    "presentation of budget",
    "List Of Questions": "list of questions starred unstarred member asked answered ministry will the minister be pleased "
    "to state shri smt question no department answer reply assembly session",
    "Government Bill": "the following bill is hereby introduced government bill be it enacted by the legislature short "
    "title commencement extent definitions chapter clause section schedule statement of objects and "
    "reasons financial memorandum",
    "Governor Speech": "address by governor honourable members joint session legislative assembly state policies "
    "achievements priorities welfare development infrastructure good governance my government "
    "address pursuant article state of the state",
    "Election": "election candidate name nomination polling booth constituency returning officer chief electoral "
    "officer commission result winner runner up votes polled valid invalid affidavit symbol party",
    "Resolutions": "this house resolves whereas now therefore be it resolved private member government resolution "
    "subject matter mover seconder discussion adoption ayes noes division strangers gallery laid "
    "before",
    "Private Member Bill": "private member bill the overseas workers welfare amendment short title objects and reasons "
    "memorandum delegated legislation by member of legislative assembly",
}

CLASS_HINTS = {
    "Gazette": ["gazette", "extraordinary", "zoram hriattima", "published by authority", "vol", "no.", "part ii"],
    "Proceedings": ["proceedings", "verbatim", "official report", "mr. speaker", "hon'ble member", "the assembly", "question hour"],
    "Budget Speech": ["budget speech", "presenting the budget", "annual financial", "estimates", "honourable members", "fiscal year"],
    "Bulletin": ["bulletin", "part - i", "part - ii", "part - iii", "bulletin part", "summary of day's proceedings"],
    "Calendar": ["calendar of sittings", "calendar", "programme of session", "dates of sittings"],
    "List Of Business": ["list of business", "presentation of papers", "presentation of budget", "obituary reference", "questions and answers"],
    "List Of Questions": ["list of questions", "starred question", "unstarred question", "will the minister be pleased", "question no."],
    "Government Bill": ["government bill", "be it enacted", "the following bill", "short title and commencement", "objects and reasons"],
    "Governor Speech": ["address by the governor", "governor's address", "honourable members", "my government", "joint session"],
    "Election": ["election commission", "returning officer", "polling station", "candidate", "constituency", "votes polled"],
    "Resolutions": ["resolution", "this house resolves", "private member's resolution", "government resolution", "be it resolved"],
    "Private Member Bill": ["private member's bill", "private member bill", "introduced by", "the overseas workers", "welfare bill"],
}

_ASSEMBLY = ("Assembly", "select", ["1", "2", "3"])
_SESSION = ("Session", "select", ["Session 1", "Session 2", "Session 3"])
_DATE = ("Date", "date", None)
_YEAR = ("Year", "year", None)
_TITLE = ("Title", "text", None)
_MEMBER = ("Member Name", "text", None)
_LANGUAGE = ("Language", "select", ["English", "Hindi"])

CLASS_SCHEMA = {
    "Gazette": [
        ("Type", "select", ["General", "Extra Ordinary", "Zoram Hriattima"]),
        ("Gazette Vol", "text", None),
        ("Gazette No", "text", None),
        _DATE,
    ],
    "Proceedings": [_ASSEMBLY, _SESSION, _DATE, _LANGUAGE],
    "Budget Speech": [("Presenter", "text", None), _DATE, _LANGUAGE],
    "Bulletin": [
        _ASSEMBLY,
        _SESSION,
        ("Bulletin Parts", "select", ["Bulletin Part I", "Bulletin Part II", "Bulletin Part III"]),
    ],
    "Calendar": [_ASSEMBLY, _SESSION],
    "List Of Business": [_ASSEMBLY, _SESSION, _DATE],
    "List Of Questions": [_ASSEMBLY, _SESSION, _DATE],
    "Government Bill": [_TITLE, _YEAR],
    "Governor Speech": [_ASSEMBLY, _SESSION, _DATE],
    "Election": [("Candidate Name", "text", None)],
    "Resolutions": [
        ("Subject", "text", None),
        ("Type Beat", "select", ["Private", "Government"]),
        _YEAR,
        _ASSEMBLY,
        _MEMBER,
        _DATE,
    ],
    "Private Member Bill": [_TITLE, _MEMBER, _YEAR],
}

ORDINAL_WORDS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5,
    "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15,
    "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20,
    "twenty-first": 21, "twenty first": 21, "twenty-second": 22, "twenty second": 22,
    "twenty-third": 23, "twenty third": 23, "twenty-fourth": 24, "twenty fourth": 24,
    "twenty-fifth": 25, "twenty fifth": 25,
}

# code -> (label, main engine language, second engine languages)
OCR_LANGUAGES = {
    "auto": ("Auto", None, None),
    "eng": ("English", "eng", ["en"]),
    "kan": ("Kannada", "kan+eng", ["kn", "en"]),
    "hin": ("Hindi", "hin+eng", ["hi", "en"]),
    "tam": ("Tamil", "tam+eng", ["ta", "en"]),
    "tel": ("Telugu", "tel+eng", ["te", "en"]),
    "mal": ("Malayalam", "mal+eng", ["ml", "en"]),
    "ben": ("Bengali", "ben+eng", ["bn", "en"]),
    "guj": ("Gujarati", "guj+eng", ["gu", "en"]),
    "mar": ("Marathi", "mar+eng", ["mr", "en"]),
}

WORLD_LANGUAGES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "zh-CN": "Chinese (Simplified)",
    "ar": "Arabic", "ja": "Japanese", "ko": "Korean", "pt": "Portuguese", "ru": "Russian", "it": "Italian",
}

INDIC_LANGUAGES = {
    "hi": "Hindi", "bn": "Bengali", "ta": "Tamil", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam",
    "mr": "Marathi", "gu": "Gujarati", "pa": "Punjabi", "ur": "Urdu", "or": "Odia (Oriya)", "as": "Assamese",
    "ne": "Nepali", "si": "Sinhala", "sd": "Sindhi", "sa": "Sanskrit", "gom": "Konkani", "mai": "Maithili",
    "mni-Mtei": "Meiteilon (Manipuri)", "doi": "Dogri",
}

DEFAULT_TARGET_LANGUAGE = "hi"
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class Taxonomy:
    """Classes in tie-break order, with seed text, hint phrases and field schema."""

    prototypes: dict[str, str] = field(default_factory=lambda: dict(CLASS_PROTOTYPES))
    hints: dict[str, list[str]] = field(default_factory=lambda: dict(CLASS_HINTS))
    schema: dict[str, list[tuple]] = field(default_factory=lambda: dict(CLASS_SCHEMA))

    @property
    def classes(self) -> list[str]:
        return list(self.prototypes)

    @classmethod
    def load(cls, path: str) -> "Taxonomy":
        with open(path, encoding="utf-8") as handle:
            raw = json.load(handle)
        return cls(
            prototypes=raw["prototypes"],
            hints=raw.get("hints", {}),
            schema={c: [(f["name"], f["type"], f.get("options")) for f in fs] for c, fs in raw.get("schema", {}).items()},
        )


def class_prototypes(spark: SparkSession, taxonomy: Taxonomy | None = None) -> DataFrame:
    t = taxonomy or Taxonomy()
    rows = [(pos, name, text) for pos, (name, text) in enumerate(t.prototypes.items())]
    return spark.createDataFrame(rows, "class_pos int, doc_class string, prototype string")


def class_hints(spark: SparkSession, taxonomy: Taxonomy | None = None) -> DataFrame:
    t = taxonomy or Taxonomy()
    rows = [(name, pos, hint) for name, hints in t.hints.items() for pos, hint in enumerate(hints)]
    return spark.createDataFrame(rows, "doc_class string, hint_pos int, hint string")


def class_schema(spark: SparkSession, taxonomy: Taxonomy | None = None) -> DataFrame:
    t = taxonomy or Taxonomy()
    rows = [(name, pos, *f) for name, fields in t.schema.items() for pos, f in enumerate(fields)]
    return spark.createDataFrame(
        rows, "doc_class string, field_pos int, name string, type string, options array<string>"
    )


def stage_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STAGES)), "stage_pos int, stage string")


def ocr_languages(spark: SparkSession) -> DataFrame:
    rows = [(pos, code, *v) for pos, (code, v) in enumerate(OCR_LANGUAGES.items())]
    return spark.createDataFrame(
        rows, "pos int, code string, label string, main_langs string, second_langs array<string>"
    )


def language_union(*groups: dict[str, str]) -> dict[str, str]:
    """Union of language groups; a later group wins; ordered by lower-cased name, then code."""
    merged: dict[str, str] = {}
    for g in groups:
        merged.update(g)
    return dict(sorted(merged.items(), key=lambda kv: (kv[1].lower(), kv[0])))


def translation_languages(spark: SparkSession) -> DataFrame:
    merged = language_union(WORLD_LANGUAGES, INDIC_LANGUAGES)
    rows = [(pos, code, name) for pos, (code, name) in enumerate(merged.items())]
    return spark.createDataFrame(rows, "pos int, code string, name string")


def ocr_language_code(c):
    """Known preset code, trimmed and lower-cased; anything else is ``auto``."""
    code = F.lower(F.trim(F.coalesce(c, F.lit("auto"))))
    return F.when(code.isin(list(OCR_LANGUAGES)), code).otherwise(F.lit("auto"))


def auto_ocr_langs(installed, default: str = "eng"):
    """Engine language string for ``auto``: every installed script, ``eng`` first when present."""
    rest = F.filter(installed, lambda c: c != "eng")
    ordered = F.when(F.array_contains(installed, "eng"), F.concat(F.array(F.lit("eng")), rest)).otherwise(installed)
    return F.when(F.size(installed) > 0, F.array_join(ordered, "+")).otherwise(F.lit(default))


def supported_target(c):
    """Target language code, or the default for one that is not offered."""
    known = list(language_union(WORLD_LANGUAGES, INDIC_LANGUAGES))
    return F.when(c.isin(known), c).otherwise(F.lit(DEFAULT_TARGET_LANGUAGE))
