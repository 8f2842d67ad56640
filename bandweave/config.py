"""Fixed values of the scoring and band rules, as data. Days and dates are always parameters of a plan."""

from __future__ import annotations

# Words that carry no topic.
STOPWORDS = (
    "a", "an", "the", "and", "or", "for", "of", "to", "in", "on", "with",
    "is", "are", "was", "were", "be", "been", "this", "that", "it", "as",
    "at", "by", "from", "into", "across", "during", "after", "over", "up",
)

# Extra keywords by capability.
KEYWORD_OVERRIDES = {
    "C001": ("api", "endpoint", "middleware", "gateway", "webhook", "auth", "routing"),
    "C002": ("reconciliation", "reconcile", "settlement", "transaction", "matching", "currency", "ledger"),
    "C003": ("recovery", "restore", "wal", "pitr", "point-in-time", "corruption", "backup", "integrity", "database", "postgresql", "postgres"),
    "C004": ("incident", "outage", "escalation", "on-call", "oncall", "pagerduty", "postmortem", "disruption", "troubleshoot"),
    "C005": ("deploy", "deployment", "rollback", "release", "canary", "blue-green", "pipeline", "ci/cd", "cicd"),
}

# Continuous scores.
STRUCTURAL_BASE, STRUCTURAL_BONUS = 0.75, 0.25
TEXTUAL_CAP, TEXTUAL_SLOPE, TEXTUAL_LEAST = 0.60, 1.2, 0.12
DECAY, DECAY_DAYS = 0.35, 365.0
DEFAULT_STRENGTH, SUM_DAMPING = 0.5, 0.5
SCORE_BANDS = (("HIGH", 0.75), ("MODERATE", 0.45), ("LOW", 0.20))
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "dd-MM-yyyy")

# Ordinal bands; compared and maximised, never added.
BANDS = ("NONE", "LOW", "MODERATE", "HIGH")
NONE, LOW, MODERATE, HIGH = range(4)
COVERAGE_THRESHOLD, FRESH_MONTHS, AGING_MONTHS, MONTH_DAYS = MODERATE, 12, 24, 30.44
CERTAINTY = ("certain", "probable", "tentative")
AUTHOR_ROLES = ("author", "pr_author")

# Source, rung, role, highest band of that role.
ROLE_CEILINGS = (
    ("github", 1, "author", 2),
    ("github", 2, "pr_author", 2),
    ("github", 3, "reviewer_substantive", 1),
    ("github", 4, "reviewer_approval", 1),
    ("github", 5, "merger_only", 0),
    ("jira", 1, "transition_actor", 2),
    ("jira", 2, "assignee_at_resolution", 2),
    ("jira", 3, "commenter_substantive", 1),
    ("jira", 4, "assignee_only", 1),
    ("jira", 5, "reporter_only", 0),
    ("incident", 1, "postmortem_author", 3),
    ("incident", 2, "escalation_target", 3),
    ("incident", 3, "resolver", 3),
    ("incident", 4, "ack_then_escalated_away", 2),
    ("incident", 5, "assigned_no_detail", 2),
    ("incident", 6, "notified_only", 0),
)

# Patterns of generated files and of service accounts; resolutions without work.
GENERATED_PATHS = (
    "package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "go.sum", "*.min.js", "*.min.css", "vendor/*",
    "node_modules/*", "*_pb2.py", "*.generated.*", "dist/*", "build/*",
)
BOT_ACTORS = (
    "*[bot]", "dependabot*", "github-actions*", "renovate*", "*-ci", "codecov*", "ci@*", "cd@*", "build@*", "builds@*",
    "pipeline@*", "deploy@*", "deployer@*", "release@*", "release-bot@*", "automation@*", "bot@*", "robot@*",
    "jenkins@*", "actions@*", "svc@*", "service@*", "noreply@*", "no-reply@*",
)
NON_WORK_RESOLUTIONS = ("Duplicate", "Won't Do", "Won't Fix", "Cannot Reproduce", "Incomplete", "Declined")

# Retrieval.
BM25_K1, BM25_B = 1.5, 0.75
BREAK_RATIO, TOP_HITS, TOP_DOCUMENTS, TOP_TERMS, IDF_LEAST = 2.0, 500, 5, 40, 3
LINK_CONFIDENCE = (("label", 1.0), ("ancestor", 0.8), ("space", 0.6))
SPACE_LEAD, SPACE_CANDIDATES = 2.0, 4
