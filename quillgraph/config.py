"""Thresholds, rules and word lists of the evidence graph, as plain data.

Fixed values: they decide results and stand here in their natural order.
"""

from __future__ import annotations

SECTION_ALIASES = (
    ("Abstract", ("Abstract",)),
    ("Introduction", ("Introduction", "Intro", "Background")),
    ("Methods", ("Methods", "Methodology", "Approach")),
    ("Results", ("Results", "Findings")),
    ("Discussion", ("Discussion", "Conclusion")),
    ("Conclusion", ("Conclusion",)),
)
SECTION_FUZZY = 85.0
AUTO_SECTION = "_auto_"
KNOWN_VENUES = (
    "Nature",
    "Science",
    "The Lancet",
    "Cell",
    "Proceedings of the National Academy of Sciences",
    "IEEE Transactions on Pattern Analysis and Machine Intelligence",
    "NeurIPS",
    "ACL",
    "ICML",
    "ICLR",
)
METADATA_PAGES = 2

#: (domain, priority, keywords): keywords count once each, lower case, as substrings.
DOMAIN_RULES = (
    ("biology", 1, ("cell", "gene", "protein")),
    ("materials", 2, ("alloy", "polymer", "crystal")),
    ("ml", 3, ("network", "training", "model")),
)
DOMAIN_WEIGHTS = {"title": 3, "venue": 4, "content": 2}
VOCABULARY_DENSITY = 0.2

TOKENS_PER_TRIPLE, MAX_TRIPLES, WORDS_PER_TRIPLE, OUTPUT_TOKENS = 60, 15, 60, 3200
MAX_MENTIONS, MAX_CANDIDATES = 12, 50

#: (canonical relation, swap, phrases), in order of configuration; the longest contained phrase wins.
RELATION_PATTERNS = (
    ("uses", False, ("uses", "employs", "makes use of")),
    ("uses", True, ("is used by", "was used by")),
    ("trained-on", False, ("trained on", "fine tuned on", "learns from")),
    ("evaluated-on", False, ("evaluated on", "tested on", "measured on")),
    ("compared-to", False, ("compared to", "compared with")),
    ("outperforms", False, ("outperforms", "surpasses", "performs better than")),
    ("improves", False, ("improves", "increases", "enhances")),
    ("reduces", False, ("reduces", "decreases", "lowers")),
    ("builds-upon", False, ("builds on", "extends")),
    ("part-of", False, ("is part of", "belongs to")),
    ("causes", False, ("causes", "leads to")),
    ("causes", True, ("is caused by", "results from")),
    ("correlates-with", False, ("correlates with", "is associated with")),
)
SEMANTIC_ACCEPT, SEMANTIC_REVIEW = 0.75, 0.6
BIDIRECTIONAL = ("related-to", "compared-to", "similar-to", "correlates-with", "benchmarked-against", "interacts-with", "binds-to")

ENTITY_TYPES = ("Method", "Dataset", "Metric", "Task", "Material")
TYPE_HINTS = (
    ("Method", ("model", "network", "algorithm", "framework", "transformer")),
    ("Dataset", ("dataset", "corpus", "benchmark", "collection")),
    ("Metric", ("accuracy", "score", "precision", "recall", "error rate")),
    ("Task", ("classification", "detection", "translation", "prediction")),
    ("Material", ("material", "compound", "polymer", "alloy")),
)
BUILTIN_TYPE_HINTS = (
    ("Method", r"\b(architecture|approach|technique|pipeline)\b"),
    ("Dataset", r"\b(corpora|data\s+set)\b"),
    ("Metric", r"\b(f1|bleu|rouge|perplexity|loss|metric)\b"),
    ("Task", r"\b(segmentation|recognition|generation|retrieval)\b"),
    ("Material", r"\b(molecule|nanotube|crystal)\b"),
)
AMBIGUOUS_TYPES = ("other", "unknown", "misc")
SPAN_RATIO = 0.88

COMENTION_DISTANCE, COMENTION_PAIRS, COMENTION_MIN, COMENTION_CONFIDENCE = 200, 10, 2, 0.3
#: Words that are no mentions, in lower case.
MENTION_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "if", "it", "its", "they", "them", "their", "this", "that", "these", "those", "we", "you", "he", "she", "him", "her", "i")
PRONOUNS = ("it", "its", "they", "them", "their", "theirs", "we", "us", "our", "ours", "he", "him", "his", "she", "her", "hers", "you", "your", "yours", "i", "me", "my", "mine")
#: A long form and its abbreviation.
ABBREVIATION = r"([A-Za-z][A-Za-z0-9\-\s]+?)\s*\(([A-Za-z0-9\-]{2,})\)"
STOP_WORDS = ("The", "This", "That", "These", "And", "With", "From")

MERGE_BASE, MERGE_BLOCKED, MERGE_POLYSEMOUS = 0.88, 0.94, 0.92
MERGE_SAME_TYPE, MERGE_CROSS_TYPE, MERGE_LEXICAL = -0.03, 0.06, -0.04
LEXICAL_MIN, LEXICAL_HIGH, NAME_MAX_TOKENS, NAME_MAX_CHARS = 0.55, 0.9, 5, 80
BLOCKED_NAMES = ("method", "model", "data", "system", "approach")
POLYSEMY_SECTIONS, SECTION_JACCARD, SECTION_SHARE = 3, 0.5, 0.05
ACRONYM_STOP_WORDS = ("of", "the", "and", "for", "in", "on", "to", "with")

PATH_CONFIDENCE, MENTION_SIMILARITY, MENTION_TOP, PATH_TOP = 0.7, 0.83, 3, 50
FALLBACK_CONFIDENCE = 0.45
SECTION_WEIGHTS = (("Results", 1.2), ("Discussion", 1.1), ("Methods", 1.1))
SUMMARY_LIMIT = 12
INTENT_KEYWORDS = {
    "paper": ("summarize", "paper", "overview"),
    "cluster": ("summarize", "cluster"),
    "entity": ("what is", "describe", "define", "explain"),
}
INTENT_THRESHOLDS = {"paper": 0.33, "cluster": 0.5, "entity": 0.25}
DOCUMENT_PREFIXES = ("paper", "doc", "document")
WH_WORDS = ("what", "which", "who", "whom", "where", "when", "why", "how")

KPI_ACCEPTANCE, KPI_SUCCESS = (0.70, 0.60), (0.97, 0.95)
KPI_NOISE, KPI_DUPLICATES = (0.90, 0.85), (0.05, 0.10)
DRIFT_DROP, DRIFT_RELATIONS = 0.25, 3
RELEVANCY, RELEVANCY_MIN_EDGES, AUDIT_MIN_EDGES = (0.70, 0.60), 5, 10
EXPORT_WARN_MB, EXPORT_BLOCK_MB, SNIPPET_CHARS = 3.0, 5.0, 200
