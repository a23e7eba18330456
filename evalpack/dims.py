"""Dimension tables: fixed rule values the results depend on.

Everything here is small and bounded (tens of rows), so it is shipped to the
executors either as literal column expressions or as broadcast DataFrames.
Nothing here grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — these must stay equal to the behaviour being reproduced.
# Schema signals in profile order: key, weight, case fields that prove the
# signal when present in any case, and the lower-case substring pattern over
# all cases.
# ---------------------------------------------------------------------------
SIGNALS = [
    ("taskInstruction", "0.11", ["instruction", "prompt", "query", "input"], "instruction|prompt|query"),
    ("input", "0.11", ["input", "messages", "context"], "input|messages|question"),
    ("expectedOutput", "0.12", ["expected", "answer", "label", "target", "gold"], "expected|answer|label|target|gold"),
    ("acceptanceCriteria", "0.10", [], "acceptancecriteria|successcriteria|criteria|must pass"),
    ("rubric", "0.09", ["rubric"], "rubric|score level|评分"),
    ("checker", "0.11", ["checker"], "checker|unit_test|assert|environment_state"),
    ("retrievalContext", "0.08", ["context", "documents", "retrievalContext"], "retrieval|documents|context"),
    ("toolTrace", "0.08", ["trace", "toolCalls", "tool_calls"], "tool_calls?|trace|span"),
    ("environmentState", "0.08", ["environment", "state"], "environment|state|sandbox|filesystem|database"),
    ("metadata", "0.05", ["metadata"], None),
    ("license", "0.04", [], None),
    ("split", "0.03", [], "train|test|validation|dev"),
]
CONFIDENCE_WITH_CASES = "0.86"
CONFIDENCE_METADATA_ONLY = "0.70"
CRITICAL_SIGNALS = ["input", "expectedOutput", "license"]

# FIXED VALUES — task-type cascade after an explicit taskType, in order.
TASK_TYPE_RULES = [
    ("rag_qa", "context|retrieval|rag|documents"),
    ("tool_use", "tool[_-]?calls?|function[_-]?calls?|api call|service_call"),
    ("code", "unit test|patch|repository|github issue|swe-bench|code"),
    ("planning", "plan|dag|workflow|dependency"),
    ("classification", "label|class|category|sentiment"),
    ("data_extraction", "entity|slot|extract|schema"),
]
RAG_TASK_TAG = "question-answering"
TASK_TYPES = ["dialogue", "rag_qa", "tool_use", "code", "planning", "classification",
              "data_extraction", "custom"]

# FIXED VALUES — readiness thresholds: level, minimum completeness, signal required.
READINESS_RULES = [
    (5, "0.82", ["checker", "license"]),
    (4, "0.68", ["expectedOutput"]),
    (3, "0.48", ["input"]),
    (2, "0.25", []),
]

# FIXED VALUES — evaluator candidates: base list, then rules applied in this
# order, each putting its items in front of the list.
EVALUATOR_BASE = ["llm_judge", "human_label"]
EVALUATOR_RULES = [
    ("expectedOutput", ["exact_match", "f1_match"]),
    ("checker", ["unit_test"]),
    ("environmentState", ["environment_state_test"]),
    ("@extraction_or_classification", ["regex_match"]),
]

# FIXED VALUES — profile note texts.
NOTE_MISSING_CHECKER = "Add deterministic checkers before selling this as a high-confidence benchmark pack."
NOTE_MISSING_LICENSE = "License metadata must be resolved before redistribution."


# FIXED VALUES — plan steps in order: ordinal, id, title, priority, automatable,
# trigger signals (fires when any is missing), extra condition, inputs, outputs.
@dataclass(frozen=True)
class StepRule:
    ordinal: int
    step_id: str
    title: str
    priority: str
    automatable: bool
    triggers: list = field(default_factory=list)
    condition: str = ""  # "", "rag_qa", "level5", "always"
    inputs: list = field(default_factory=list)
    outputs: list = field(default_factory=list)


STEP_RULES = [
    StepRule(1, "normalize-input", "Normalize raw samples into explicit Agent inputs", "critical", True, ["input"],
             inputs=["source samples", "README schema notes"], outputs=["input field", "caseId", "task instruction"]),
    StepRule(2, "derive-gold-expected", "Derive or annotate gold expected outputs", "critical", False, ["expectedOutput"],
             inputs=["source labels", "accepted answers", "human review rubric"], outputs=["expected field", "gold answer provenance"]),
    StepRule(3, "resolve-license", "Resolve license and redistribution policy", "critical", True, ["license"],
             inputs=["dataset card", "repository license", "source terms"], outputs=["licenseName", "commercialRisk", "redistributionRisk"]),
    StepRule(4, "generate-rubric", "Generate task-specific rubrics and acceptance criteria", "high", True, ["rubric", "acceptanceCriteria"],
             inputs=["task type", "industry workflow", "expected outputs"], outputs=["rubric", "acceptanceCriteria"]),
    StepRule(5, "synthesize-checkers", "Synthesize deterministic checker candidates", "high", True, ["checker"],
             inputs=["expected outputs", "rubric", "case metadata"], outputs=["exact/regex/unit checker specs", "checker confidence"]),
    StepRule(6, "attach-context", "Attach retrieval context and provenance snapshots", "high", True, ["retrievalContext"], "rag_qa",
             inputs=["source documents", "dataset references"], outputs=["context", "provenance snapshots"]),
    StepRule(7, "spec-agent-environment", "Add tool trace and environment state specifications", "medium", True, ["toolTrace", "environmentState"],
             inputs=["workflow focus", "tool API assumptions", "state fixtures"], outputs=["toolTrace", "environment", "state assertions"]),
    StepRule(8, "package-splits", "Package train/dev/test splits with provenance metadata", "medium", True, ["split", "metadata"],
             inputs=["normalized cases", "source metadata"], outputs=["split", "metadata", "manifest provenance"]),
    StepRule(9, "commercial-hardening", "Calibrate reviewer rubrics and executable checker adapters", "high", False, [], "level5",
             inputs=["rubric", "checker specs", "pilot model runs"], outputs=["reviewer calibration examples", "executable checker adapters", "quality report"]),
    StepRule(10, "industry-packaging", "Package as {industry} Agent benchmark workflow", "medium", True, [], "always",
             inputs=["industry taxonomy", "workflow focus", "readiness profile"], outputs=["benchmark pack description", "buyer-facing gap report"]),
]
# FIXED VALUES — lift per step priority.
PRIORITY_LIFT = {"critical": "0.13", "high": "0.09", "medium": "0.05"}

# FIXED VALUES — packaging risks, in order: missing signal, message.
PACKAGING_RISKS = [
    ("license", "Cannot redistribute or sell until license metadata is resolved."),
    ("expectedOutput", "Cannot claim benchmark validity without gold expected outputs."),
    ("checker", "Needs deterministic checkers before being positioned as a high-confidence eval pack."),
    ("environmentState", "Long-horizon Agent claims are weak without environment fixtures or state assertions."),
]

# FIXED VALUES — recommended next actions: conditional ones keyed by missing
# critical signal, then two constant ones.
NEXT_ACTIONS_IF_MISSING = [
    ("license", "Resolve license and redistribution policy before publishing a data pack."),
    ("expectedOutput", "Add gold expected outputs or acceptance criteria."),
    ("input", "Normalize source samples into explicit input fields."),
]
NEXT_ACTIONS_ALWAYS = [
    "Add deterministic checker artifacts for high-value Agent benchmark tasks.",
    "Attach provenance snapshots for source README, metadata JSON, and sample rows.",
]

# FIXED VALUES — gap-fill target field per missing signal (license, split: none).
SIGNAL_TO_FIELD = [
    ("taskInstruction", "input"),
    ("input", "input"),
    ("expectedOutput", "expected"),
    ("acceptanceCriteria", "rubric"),
    ("rubric", "rubric"),
    ("checker", "checker"),
    ("retrievalContext", "context"),
    ("toolTrace", "trace"),
    ("environmentState", "environment"),
    ("metadata", "metadata"),
]

# ---------------------------------------------------------------------------
# Industry taxonomy. FIXED VALUES — the stock taxonomy: slug, label,
# keywords, agent workflows, in taxonomy order.
# ---------------------------------------------------------------------------
STOCK_TAXONOMY = [
    ("customer-service", "Customer Service",
     ["customer", "support", "ticket", "complaint", "refund", "return", "escalation", "faq", "service"],
     ["ticket triage", "refund handling", "escalation", "FAQ grounding"]),
    ("finance", "Finance",
     ["finance", "financial", "bank", "banking", "insurance", "claim", "risk", "fraud", "payment", "loan"],
     ["claim review", "risk analysis", "complaint classification", "financial QA"]),
    ("healthcare", "Healthcare",
     ["medical", "health", "clinical", "patient", "doctor", "triage", "diagnosis", "hospital", "medicine"],
     ["medical QA", "patient intake", "clinical summarization", "safety escalation"]),
    ("legal", "Legal",
     ["legal", "law", "contract", "compliance", "policy", "case", "court", "clause", "regulation"],
     ["contract extraction", "case research", "compliance review", "policy QA"]),
    ("education", "Education",
     ["education", "exam", "student", "tutor", "course", "curriculum", "grading", "learning", "school"],
     ["tutoring", "grading", "feedback generation", "curriculum QA"]),
    ("software", "Software Engineering",
     ["code", "software", "github", "repository", "swe", "bug", "programming", "pull request", "test"],
     ["bug fixing", "code review", "test generation", "permission-aware execution"]),
    ("research", "Research",
     ["research", "paper", "citation", "literature", "study", "evidence synthesis"],
     ["paper search", "evidence synthesis", "citation audit", "dataset analysis"]),
    ("procurement", "Procurement",
     ["procurement", "vendor", "purchase", "quote", "supplier", "rfp", "sourcing", "contract intake"],
     ["vendor comparison", "quote extraction", "purchase approval", "contract handoff"]),
    ("hr", "Human Resources",
     ["hr", "human resources", "recruiting", "resume", "interview", "onboarding", "employee", "policy"],
     ["resume screening", "interview scheduling", "onboarding", "policy QA"]),
    ("ecommerce", "E-commerce",
     ["ecommerce", "e-commerce", "shopping", "order", "product", "review", "cart", "merchant", "returns"],
     ["product recommendation", "order tracking", "returns", "review mining"]),
    ("logistics", "Logistics",
     ["logistics", "shipment", "shipping", "warehouse", "route", "delivery", "eta", "tracking"],
     ["shipment exception", "route planning", "warehouse update", "ETA communication"]),
    ("manufacturing", "Manufacturing",
     ["manufacturing", "factory", "maintenance", "quality control", "inventory", "incident", "operations"],
     ["quality inspection", "maintenance planning", "incident report", "inventory check"]),
    ("government", "Government",
     ["government", "public service", "citizen", "form", "agency", "policy guidance", "open data"],
     ["form assistance", "policy lookup", "case routing", "public data QA"]),
    ("general", "General", [],
     ["classification", "QA", "summarization", "reasoning"]),
]
# FIXED VALUES — industry scoring constants.
INDUSTRY_EXPLICIT_BOOST = "0.45"
INDUSTRY_KEYWORD_STEP = "0.11"
INDUSTRY_KEYWORD_CAP = "0.45"
INDUSTRY_WORKFLOW_STEP = "0.05"
INDUSTRY_WORKFLOW_CAP = "0.10"
INDUSTRY_FALLBACK_SLUG = "general"
INDUSTRY_FALLBACK_CONFIDENCE = "0.2"
INDUSTRY_SPECIFIC_MIN = "0.3"
INDUSTRY_TOP_K = 3

# Stand-in taxonomy for the driver tables. The stock keywords almost never
# occur in the invented prose, so oracle queries take this taxonomy as a
# parameter instead; its keywords are frequent invented words, one
# multi-word phrase and one hyphenated word so that every match path runs.
STANDIN_TAXONOMY = [
    ("alpha", "Alpha", ["thing", "ering", "license", "the end"], ["erble", "atst on"]),
    ("beta", "Beta", ["erble", "attion", "thon"], ["thing", "mit license"]),
    ("gamma", "Gamma", ["tion", "thes", "co-op"], ["ering"]),
    ("delta", "Delta", ["apache", "gnu", "zzqx"], ["general public license"]),
    ("general", "General", [], ["version"]),
]

# ---------------------------------------------------------------------------
# Catalog rules. FIXED VALUES — license risk patterns (case-insensitive), hub
# variant and code-host variant, each in evaluation order.
# ---------------------------------------------------------------------------
RISK_RESTRICTED = "noncommercial|non-commercial|cc-by-nc|nc-"
RISK_LOW_HUB = "mit|apache|bsd|cc-by|cc0"
RISK_LOW_REPO = "mit|apache|bsd|cc0"
RISK_MEDIUM_HUB = "gpl|agpl|cc-by-sa|cc-by-nc"
RISK_MEDIUM_REPO = "gpl|agpl|lgpl"

# FIXED VALUES — code-host task tags (pattern over lower-cased text), in order;
# default tag when none fires.
REPO_TASK_RULES = [
    ("rag_qa", "rag|retrieval|question answering|qa"),
    ("tool_use", "tool|agent|function call"),
    ("code", "code|swe|programming"),
    ("classification", "classification|label"),
]
REPO_TASK_DEFAULT = "benchmark"
# FIXED VALUES — modality tags: always text, then these.
MODALITY_RULES = [("image", "image|vision"), ("audio", "audio|speech"), ("video", "video")]

# FIXED VALUES — page of a hub dataset, its card, and the archive of a repository.
HUB_PAGE = "https://huggingface.co/datasets/"
HUB_CARD = "/resolve/main/README.md"
REPO_ARCHIVE = "/archive/refs/heads/main.zip"

# FIXED VALUES — query-variant stop words.
QUERY_STOPWORDS = ["agent", "benchmark", "dataset", "eval", "evaluation", "test", "testing"]

# FIXED VALUES — synthesis defaults.
DEDUPE_JACCARD_THRESHOLD = 0.85
DEDUPE_COSINE_THRESHOLD = 0.92
JUDGE_PASS_THRESHOLD = 0.6
JUDGE_UNAVAILABLE = "judge-unavailable"
MAX_ATTEMPTS = 3
SPEC_DEFAULT_COUNT = 10
SPEC_DEFAULT_MODE = "from-scratch"
SPEC_MODES = ["seeded", "from-scratch"]
SPEC_DEFAULT_FIELDS = ["input", "expected", "rubric", "checker"]
SEED_EXAMPLES = 3
ENGINE_LABEL = "evalpack"
MANIFEST_VERSION = "evalpack.manifest.v0"

# FIXED VALUES — parse failure reasons (our own short codes).
PARSE_JSON_FAILED = "json_parse_failed"
PARSE_NOT_OBJECT = "not_object"
PARSE_MISSING_CASE_ID = "missing_case_id"
CALL_FAILED = "call_failed"
NO_COMPLETION = "no_completion"

# FIXED VALUES — capability rubric verdict values and score tiers.
VERDICT_VALUES = [("YES", "1.0"), ("PARTIAL", "0.5"), ("NO", "0.0")]
SCORE_TIERS = [("excellent", "0.8"), ("good", "0.6"), ("fair", "0.4")]
SCORE_TIER_DEFAULT = "poor"
