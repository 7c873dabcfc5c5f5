"""Vocabularies of the note format."""

from __future__ import annotations

# Fixed values of the format, in its own order.
SENSITIVITY = ("public", "internal", "restricted", "confidential", "regulated", "phi", "secret")
DEFAULT_SENSITIVITY = "secret"
EPISTEMIC_STATES = ("hypothesis", "fact", "unknown")
EPISTEMIC_FALLBACK = "unknown"
SENSITIVITY_MISSING = "OKF-SENSITIVITY-001"
EPISTEMIC_INVALID = "OKF-EPISTEMIC-002"
TASKS = {
    "explain": "diagnostic_explanation",
    "improve": "documentation_improvement",
    "repair": "metadata_repair",
    "find-links": "relationship",
    "find-claims": "claim_extraction",
    "check-conflicts": "contradiction",
    "check-privacy": "classification_raise",
}
LOOPBACK_HOSTS = ("127.0.0.1", "localhost", "[::1]")
DEFAULT_PORT = 4814
SUPERVISOR_STATES = ("stopped", "indexing", "serving", "error")
MAX_RESTARTS = 3
BACKOFF_MS = 500
REQUEST_SECONDS = 30.0

# Codes that the format leaves open; ours.
SENSITIVITY_INVALID = "OKF-SENSITIVITY-002"
EPISTEMIC_MISSING = "OKF-EPISTEMIC-001"
TEMPORAL_NAIVE = "OKF-TEMPORAL-001"
FRONT_MATTER_INVALID = "OKF-FRONTMATTER-001"
IDENTITY_DUPLICATE = "OKF-IDENTITY-001"
LINK_DANGLING = "OKF-LINK-001"
LINEAGE_CYCLE = "OKF-LINEAGE-001"
SEVERITIES = ("info", "warning", "error", "critical")
GATE = ("error", "critical")
