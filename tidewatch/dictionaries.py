"""Small dictionaries for the fixture headlines: parameters of operators, held as plain lists."""

from __future__ import annotations

EVENT_KEYWORDS = [  # type, keyword, weight; types in order of precedence
    ("airstrike", "airstrike", 10), ("airstrike", "air raid", 6), ("missile", "missile strike", 10), ("missile", "missile", 6),
    ("drone", "drone attack", 10), ("drone", "drone", 5), ("explosion", "explosion", 8), ("fire", "wildfire", 8),
    ("infrastructure", "refinery", 4), ("infrastructure", "port", 1), ("troop_movement", "troops deployed", 9), ("alert", "sirens", 5), ("alert", "warning", 3),
]
EVENT_TYPES = ["airstrike", "missile", "drone", "explosion", "fire", "infrastructure", "troop_movement", "alert"]
SEVERITY_WORDS = [("dozens killed", 2), ("killed", 1), ("casualties", 1), ("breaking", 1), ("minor", -1), ("talks", -1)]
THREATS = [  # level, keyword, category; in order of precedence
    ("critical", "missile strike", "military"), ("critical", "airstrike", "military"), ("high", "drone attack", "military"), ("high", "explosion", "conflict"),
    ("high", "air raid", "military"), ("medium", "troops", "military"), ("medium", "clashes", "unrest"), ("medium", "earthquake", "disaster"),
    ("medium", "data breach", "cyber"), ("low", "protest", "unrest"), ("low", "sanctions", "diplomatic"), ("low", "talks", "diplomatic"),
]
THREAT_CONFIDENCE = {"critical": 0.9, "high": 0.8, "medium": 0.7, "low": 0.6, "info": 0.3}
LEVEL_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
EXCLUSIONS = ["opinion:", "earnings"]
BREAKING = ["breaking", "strike", "attack", "explosion", "killed", "air raid"]
TIERS = [  # tier, base, bonus, keywords
    ("violence", 100, 25, ["killed", "strike", "attack", "explosion"]), ("military", 80, 20, ["troops", "missile", "drone"]),
    ("unrest", 40, 15, ["protest", "clashes", "curfew"]), ("flashpoint", 0, 20, ["gaza", "tehran", "beirut", "iraq"]), ("crisis", 0, 10, ["casualties", "sirens", "sanctions", "tsunami"]),
]
DEMOTIONS = ["earnings", "shares", "startup", "opinion"]
GAZETTEER = [  # name, latitude, longitude, country, importance, seq
    ("tehran", 35.69, 51.39, "Iran", 3, 1), ("iraq", 33.22, 43.68, "Iraq", 1, 2), ("cairo", 30.04, 31.24, "Egypt", 3, 3), ("beirut", 33.89, 35.50, "Lebanon", 3, 4),
    ("baghdad", 33.31, 44.37, "Iraq", 3, 5), ("gaza", 31.50, 34.47, "Palestine", 2, 6), ("tel aviv", 32.09, 34.78, "Israel", 3, 7), ("suez canal", 30.46, 32.35, "Egypt", 2, 8), ("russia", 61.52, 105.32, "Russia", 1, 9),
]
ENTITIES = [  # entity, word
    ("nato", "nato"), ("ru", "russia"), ("ir", "iran"), ("ir", "tehran"), ("iq", "iraq"), ("iq", "baghdad"), ("eg", "cairo"), ("eg", "suez"), ("lb", "beirut"), ("ps", "gaza"), ("il", "tel aviv"),
]
HOTSPOT_WORDS = [("h1", "tehran"), ("h1", "oil"), ("h2", "baghdad"), ("h2", "iraq"), ("h3", "suez"), ("h4", "tehran"), ("h4", "sirens")]
COMMON_WORDS = ["the", "and", "for", "near", "over", "after", "from", "with", "that", "this", "der", "die", "und"]
RELIABILITY = [("src1", 85), ("src2", 70), ("src10", 90), ("src5", 40), ("src3", 62)]  # part of a domain, score; the first in this order counts
SOURCE_TIERS = [("src0", 1), ("src1", 1), ("src2", 2), ("src3", 2), ("src4", 3)]
ENTITY_WORDS = [  # entity, word, kind, seq; of equal words of a kind the last by seq counts
    ("ir", "tehran", "keyword", 1), ("me", "tehran", "keyword", 2), ("iq", "iraq", "keyword", 3), ("iq", "baghdad", "alias", 4), ("me", "baghdad", "alias", 5), ("oil", "oil refinery", "keyword", 6),
    ("nato", "nato", "alias", 7), ("un", "un", "alias", 8), ("lb", "beirut port", "keyword", 9), ("lb", "beirut", "alias", 10), ("es", "los", "alias", 11), ("fr", "une", "keyword", 12),
]
