"""Settings and fixed value lists.

Everything a caller may want to change is a field of ``AuditConfig`` and is
passed explicitly; nothing here is mutated at run time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Header aliases, in order of preference per logical column.
# ---------------------------------------------------------------------------
COLUMN_ALIASES: dict[str, tuple[str, ...]] = {
    "ticket_id": ("Ticket ID", "ticket_id", "id", "ID", "TicketID"),
    "subject": ("Ticket Subject", "Subject", "subject", "title", "Title"),
    "description": (
        "Ticket Description", "Description", "description", "body", "Body", "message", "Message",
    ),
    "priority": (
        "Ticket Priority", "Priority", "priority", "Priority_Level", "urgency", "Urgency",
    ),
    "ticket_type": (
        "Ticket Type", "Type", "type", "ticket_type", "Category", "category", "Issue_Category",
    ),
    "status": ("Ticket Status", "Status", "status"),
    "channel": ("Ticket Channel", "Channel", "channel", "source", "Source"),
    "resolution": ("Resolution", "resolution", "resolution_text", "Solution"),
    "customer_name": ("Customer Name", "Name", "customer_name"),
    "product": ("Product Purchased", "Product", "product"),
    "csat": (
        "Customer Satisfaction Rating", "CSAT", "csat", "satisfaction_rating", "Rating",
        "Satisfaction_Score",
    ),
    "first_response": ("First Response Time", "first_response_time", "response_time"),
    "resolution_time": (
        "Time to Resolution", "resolution_time", "time_to_resolution", "handle_time",
        "Resolution_Time_Hours",
    ),
    "date_purchased": ("Date of Purchase", "date_purchased", "purchase_date"),
}

REQUIRED_COLUMNS = ("subject", "description", "priority")

# Strings that a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---------------------------------------------------------------------------
# The ordinal domain and its score bands [low, high).
# ---------------------------------------------------------------------------
LEVELS = ("low", "medium", "high", "critical")
LEVEL_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
BAND_UPPER = (("low", 0.30), ("medium", 0.55), ("high", 0.78), ("critical", 1.01))
BAND_EDGES = (0.30, 0.55, 0.78)

# Words that name a priority, tried in this order.
PRIORITY_WORDS = {
    "critical": r"critical|urgent|emergency|p0|p1|sev1|severity[\s\-]?1",
    "high": r"high|hi|p2|sev2|severity[\s\-]?2",
    "medium": r"medium|med|moderate|p3|sev3|severity[\s\-]?3",
    "low": r"low|lo|minor|p4|p5|sev4|sev5|severity[\s\-]?[45]",
}

# ---------------------------------------------------------------------------
# Urgency phrases per level, and negation words.
# ---------------------------------------------------------------------------
CRITICAL_PHRASES = (
    "system down", "complete outage", "total failure", "data loss", "data breach",
    "security breach", "cannot access", "unable to access", "entirely broken",
    "production down", "server down", "database down", "payment failing",
    "all users affected", "critical error", "emergency", "urgent help",
    "immediately", "asap", "as soon as possible", "losing data", "corrupted",
    "company halted", "business stopped", "cannot function", "security vulnerability",
    "ransomware", "unauthorized access", "credentials stolen", "severe impact",
    "multiple users affected", "revenue loss", "sla breach", "deadline missed",
)
HIGH_PHRASES = (
    "not working", "broken", "major issue", "significant problem", "disrupted",
    "keeps failing", "repeated failure", "very slow", "severely degraded",
    "several users", "team affected", "functionality lost", "error repeatedly",
    "blocked", "cannot complete", "overdue", "escalate", "need urgent",
    "frustrated", "unacceptable", "very disappointed", "angry",
)
MEDIUM_PHRASES = (
    "problem", "issue", "error", "bug", "glitch", "not responding",
    "sometimes fails", "intermittent", "slow", "delayed", "minor disruption",
    "unexpected behavior", "wrong result", "incorrect", "workaround needed",
)
LOW_PHRASES = (
    "question", "inquiry", "how to", "wondering", "could you please",
    "request for information", "general question", "curious", "help me understand",
    "feature request", "enhancement", "suggestion", "when will", "nice to have",
    "minor", "cosmetic", "typo", "spelling",
)
NEGATION_WORDS = (
    "not", "no", "never", "cannot", "can't", "won't", "doesn't", "didn't",
    "isn't", "aren't", "wasn't", "weren't", "nothing", "nowhere", "nobody",
)

# Matching order of the levels: most severe first.
LEXICON: tuple[tuple[str, int, tuple[str, ...]], ...] = (
    ("critical", 3, CRITICAL_PHRASES),
    ("high", 2, HIGH_PHRASES),
    ("medium", 1, MEDIUM_PHRASES),
    ("low", 0, LOW_PHRASES),
)

# What each label probability contributes to the model signal.
LABEL_PROBABILITY_WEIGHTS = {
    "p_critical": 1.0, "p_high": 0.67, "p_medium": 0.33, "p_low": 0.0,
}
# The hypotheses a zero-shot model is asked to choose between.
LABEL_HYPOTHESES = {
    "p_critical": "This is a critical emergency requiring immediate attention",
    "p_high": "This is a high priority serious issue",
    "p_medium": "This is a medium priority issue",
    "p_low": "This is a low priority minor inquiry",
}

# ---------------------------------------------------------------------------
# Order of the structural features, and their display names.
# ---------------------------------------------------------------------------
STRUCTURAL_FEATURES = (
    "text_length", "word_count", "exclamation_count", "question_count", "caps_ratio",
    "csat_norm", "csat_inverted", "first_response_minutes_norm",
    "resolution_time_minutes_norm", "channel_enc", "ticket_type_enc", "status_enc",
    "inferred_severity_score", "severity_confidence", "urgency_lexicon_score",
)
FEATURE_DISPLAY_NAMES = {
    "text_length": "Ticket text length",
    "word_count": "Word count",
    "exclamation_count": "Exclamation marks count",
    "question_count": "Question marks count",
    "caps_ratio": "Proportion of uppercase letters",
    "csat_norm": "Customer satisfaction score",
    "csat_inverted": "Low customer satisfaction signal",
    "first_response_minutes_norm": "First response time",
    "resolution_time_minutes_norm": "Resolution time",
    "channel_enc": "Ticket channel (email/chat/phone)",
    "ticket_type_enc": "Ticket type/category",
    "status_enc": "Ticket status",
    "inferred_severity_score": "Inferred severity score (ensemble)",
    "severity_confidence": "Severity inference confidence",
    "urgency_lexicon_score": "Urgency keyword score",
}
ENCODED_COLUMNS = ("channel", "ticket_type", "status")

# Column order of the two table exports.
PSEUDO_LABEL_COLUMNS = (
    "ticket_id", "priority", "priority_rank", "inferred_severity", "inferred_severity_rank",
    "inferred_severity_score", "urgency_lexicon_score", "nli_severity_score", "structural_score",
    "sentiment_score", "severity_confidence", "priority_gap", "is_mismatch",
    "mismatch_direction", "pseudo_label_confidence", "pseudo_label_quality",
    "include_in_training", "full_text", "subject", "description",
)
PREDICTION_COLUMNS = (
    "ticket_id", "priority", "inferred_severity", "inferred_severity_score",
    "severity_confidence", "priority_gap", "is_mismatch", "mismatch_probability",
    "mismatch_predicted", "mismatch_direction", "confidence_level", "subject", "description",
)

@dataclass(frozen=True)
class BoosterConfig:
    """Boosted-tree settings, in Spark ML terms.

    ``max_depth`` 6 gives at most 64 leaves per tree. Rounds stop when the loss on a
    held-out fold has not improved for ``patience`` rounds; the best round is kept.
    ``ridge`` and ``max_iter`` also hold for the linear learner.
    """

    learner: str = "gbt"  # or "logistic"
    max_iter: int = 500
    step_size: float = 0.05
    max_depth: int = 6
    min_instances_per_node: int = 20
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    patience: int = 50
    ridge: float = 0.01
    max_memory_mb: int = 512


@dataclass(frozen=True)
class AuditConfig:
    """All tunable settings of an audit run."""

    # severity ensemble
    weight_lexicon: float = 0.35
    weight_model: float = 0.35
    weight_structural: float = 0.20
    weight_sentiment: float = 0.10
    structural_min_rows: int = 10
    model_text_chars: int | None = None  # a model's own input limit, if it has one
    # pseudo labels
    gap_threshold: int = 1
    min_confidence: float = 0.55
    # features
    tfidf_max_features: int = 3000
    tfidf_min_df: int = 2
    # training
    min_training_rows: int = 50
    cv_folds: int = 5
    calibration_folds: int = 3
    seed: int = 42
    booster: BoosterConfig = field(default_factory=BoosterConfig)
    # evidence
    top_attributions: int = 5
    top_spans: int = 3
    context_chars: int = 30
    snippet_chars: int = 300
    action_min_probability: float = 0.40
    document_title: str = "Ticket Priority Dossier"
    generator_name: str = "prioscope"
    timestamp: str = ""
