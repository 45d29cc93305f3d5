"""Word lists, patterns, thresholds and texts.  All are fixed values that results depend on; each function takes its list as a parameter."""

# Complaint and request patterns, each counted once.
PAIN_PATTERNS = [
    r"\bi wish\b", r"\bwhy can'?t\b", r"\bhow do i\b", r"\bdoes anyone else\b", r"\bhate (that|when|how)\b", r"\bfrustrat(e|ed|ing)\b",
    r"\bannoy(e|ing|ed)\b", r"\bstruggl(e|ing)\b", r"\bproblem with\b", r"\bissue with\b", r"\bbug(gy)?\b", r"\bbroken\b", r"\bsucks\b",
    r"\bterrible\b", r"\bworst\b", r"\bunusable\b", r"\bplease (add|fix|support)\b", r"\bis there (a|an) (easy|simple) way\b",
    r"\brecommend(ations?)?\b", r"\balternative to\b", r"\blooking for\b", r"\bneed (a|to)\b", r"\bwant (to|a)\b",
    r"\bwould (love|like) (to|a)\b", r"\bhoping (for|to)\b", r"\brequest\b", r"\bfeature request\b",
]
# Substrings that mark a sentence as evidence.
PAIN_WORDS = ["blocked", "locked", "can't", "cannot", "failed", "billing", "support", "hate", "frustrat", "broken", "sucks", "worst", "wish", "need", "stuck", "unusable", "terrible", "annoy", "struggl", "problem", "issue", "bug", "please fix", "please add", "why can't", "how do i", "recommend"]
# Substrings that mark an evidence span as pain.
SPAN_WORDS = ["blocked", "locked", "can't", "failed", "billing", "support", "hate", "frustrat", "broken", "sucks", "worst", "wish", "need"]
# Substrings that rank comments.
COMMENT_WORDS = ["we had to", "this broke", "in production", "on-call", "incident", "workaround", "we ended up", "security", "migration", "blocked", "failed", "can't", "cannot", "hate", "frustrat", "broken", "stuck", "problem", "issue", "bug", "wish", "need"]
# Substrings of which one makes a topic coherent.
DIRECT_INDICATORS = ["sql injection", "hardcoded key", "vulnerability", "vulnerabilities", "exploit", "prompt injection", "xss", "rce", "data breach", "security patch", "cve", "zero day", "auth bypass", "secret leak"]
# Phrases not allowed in items, and the further ones not allowed in cards.
BANNED = ["this highlights", "this showcases", "this contributes", "raises questions about", "existing tools are often", "need for robust", "increased competition"]
CARD_BANNED = BANNED + ["unclear from evidence", "not enough evidence", "not enough info", "unclear from the evidence", "ai proliferation", "encryption concerns", "ai proliferation / encryption"]
# Words of a tangible product.
TANGIBLE = ["scanner", "diff", "verifier", "simulator", "dashboard", "cli", "webhook", "api", "tool", "plugin", "check", "report", "runner", "pipeline", "notifier", "bot", "script", "widget", "layer", "gate", "guard", "linter", "checker", "monitor", "audit", "export", "sync"]
# Words of urgency; words of what is at stake.
URGENCY = ["urgent", "deadline", "must", "critical", "breaking", "immediate", "compliance", "regulation", "required"]
STAKES = ["time", "hours", "days", "latency", "delay", "mttr", "engineer-hours", "weeks", "reliability", "outage", "downtime", "incident", "sev", "availability", "uptime", "security", "breach", "compliance", "vulnerability", "risk", "exposure", "cost", "money", "budget", "spend", "waste", "pay", "dollar", "revenue"]
# Signs that a title names a failure.
FAILURE_SIGNS = [" can ", " can't ", " cannot ", " breaks ", " fail", " break ", " infects ", " erodes ", " won't ", " doesn't ", " don't ", " blocks ", " block ", " lose ", " loses ", " one ", " single ", " overnight ", " unable to ", " when ", " → ", " vs "]
FAILURE_VERBS = ["break", "fail", "infect", "block", "lose", "cost", "hurt", "drop", "miss"]
# Weights and thresholds of the score, and penalties.
WEIGHTS = {"audience_fit": 0.35, "pain_intensity": 0.30, "actionability": 0.25, "confidence": 0.10}
MIN_AUDIENCE, MIN_PAIN, MIN_ACTION, MIN_CONFIDENCE = 0.65, 0.50, 0.60, 0.55
PENALTY_SHOW, PENALTY_FEED, PENALTY_EXCLUDED = 0.25, 0.25, 0.20
LABELS = ["PAIN", "DISCUSSION", "NEWS", "OTHER"]
# Texts that stand in where a card lacks them.
PROXY_STAKES = ["Estimate: engineer-hours and MTTR risk when incidents recur.", "Proxy: reliability and security impact (likely sev escalation if unaddressed)."]
# Topics that are left out of news.
EXCLUDED = ["local human interest", "agriculture/food giveaways", "sports", "celebrity", "lifestyle", "pure politics"]
