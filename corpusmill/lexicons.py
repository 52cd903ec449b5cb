"""Word lists and patterns the text features use, and their replacement from a folder of YAML files."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Results depend on them, so they are as published.

LABELS = {"EASY": "Easy", "Easy": "Easy", "easy": "Easy", "1": "Easy", "MEDIUM": "Moderate", "Medium": "Moderate", "Moderate": "Moderate", "2": "Moderate", "HARD": "Hard", "Hard": "Hard", "3": "Hard", "VERY_HARD": "Hard", "Very-Hard": "Hard", "Medium-Hard": "Hard"}
TASKS = {
    "Define": ["define", "defines", "defined", "definition"],
    "Explain": ["explain", "explains", "explained", "explanation"],
    "Calculate": ["calculate", "calculates", "calculated", "compute", "computes", "computed"],
    "Compare": ["compare", "compares", "compared", "contrast", "contrasts"],
    "Analyze": ["analyze", "analyzes", "analyzed", "analyse", "analyses", "analysed", "derive", "derives", "derived"],
    "Design": ["design", "designs", "designed", "construct", "constructs", "constructed", "implement", "implements", "implemented"],
    "Prove": ["prove", "proves", "proved", "proof", "demonstrate", "demonstrates", "demonstrated"],
    "Describe": ["describe", "describes", "described", "discuss", "discusses", "discussed"],
    "Identify": ["identify", "identifies", "identified", "find", "finds", "determine", "determines", "determined"],
}
BLOOM = {
    "Remember": ["define", "list", "name", "identify", "recall", "state"],
    "Understand": ["explain", "describe", "summarize", "interpret", "classify"],
    "Apply": ["calculate", "compute", "implement", "use", "solve", "apply"],
    "Analyze": ["analyze", "compare", "contrast", "differentiate", "derive"],
    "Evaluate": ["evaluate", "justify", "critique", "assess", "verify"],
    "Create": ["design", "construct", "formulate", "develop", "create", "prove"],
}
CONCEPTS = ["binary search", "dynamic programming", "graph", "tree", "heap", "recursion", "sorting", "hashing", "probability", "matrix", "derivative", "integral", "compiler", "grammar", "algorithm"]
TECHNICAL = ["complexity", "asymptotic", "polynomial", "logarithmic", "recursive", "iterative", "optimization", "constraint", "memory", "runtime", "data structure", "algorithm", "function", "variable", "array", "string", "integer", "graph"]
ALGORITHMS = {"array": 1, "string": 1, "sorting": 2, "hash map": 2, "hashmap": 2, "stack": 2, "queue": 2, "binary search": 3, "tree": 3, "heap": 3, "recursion": 3, "graph": 4, "bfs": 4, "dfs": 4, "dynamic programming": 4, "topological sort": 4, "max-flow": 5, "suffix automaton": 5, "segment tree": 5, "fft": 5, "np-hard": 5}
CONSTRAINTS = [
    r"(?i)\b(?:n|m|k|q)\s*(?:<=|≤|<)\s*([0-9][0-9,_]*(?:(?:\^|[eE])[+-]?\d+)?)\b",
    r"(?i)\b1\s*≤\s*[nmkq]\s*≤\s*([0-9][0-9,_]*(?:(?:\^|[eE])[+-]?\d+)?)\b",
    r"(?i)\b(?:up to|at most)\s+([0-9][0-9,_]*(?:(?:\^|[eE])[+-]?\d+)?)\b",
]
NUMBER = r"(?<![A-Za-z0-9_])[+-]?[0-9][0-9,_]*(?:(?:\^|[eE])[+-]?[0-9]+)?(?![A-Za-z0-9_])"
NEGATIONS = ["no", "not", "never", "none", "neither", "nor", "without", "cannot", "n't", "unless", "except"]
OPTION_MARKERS = [r"^\s*\([A-Da-d]\)\s+", r"^\s*[A-Da-d][.)]\s+", r"^\s*[1-9][0-9]*[.)]\s+", r"^\s*(?:Option\s+)[A-Da-d](?:[.)]?)\s+", r"^\s*\[[A-Da-d]\]\s+", r"^\s*(?:Option\s+)?[A-Da-d]:\s+"]
CODE_SIGNATURES = [r"^\s*def\s+", r"^\s*class\s+", r"^\s*function\s+", r"^\s*public\s+static\b", r"^\s*#include\b", r"^\s*import\s+", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bif\s*\(", "=>", r";\s*$", r"\{[^{}]*\}"]
BRANCHES = ["if", "else if", "elif", "for", "while", "case", "catch", "&&", "||", "?"]
LOOPS = ["for", "while", "foreach"]
ABBREVIATIONS = ["e.g.", "i.e.", "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "fig.", "eq.", "no.", "approx.", "inc.", "dept."]
QUESTION_TYPES = ["What", "Why", "How", "Which", "When", "Where", "YesNo", "Other"]
INSTRUCTION_TYPES = ["Define", "Explain", "Calculate", "Compare", "Analyze", "Design", "Prove", "Describe", "Identify", "Other"]
AUXILIARIES = ["is", "are", "was", "were", "do", "does", "did", "can", "could", "will", "would", "should", "has", "have", "had"]
CLAUSE_HEADS = ["ROOT", "ccomp", "xcomp", "advcl", "relcl", "acl", "csubj", "csubjpass"]
CLASSES = ("Easy", "Moderate", "Hard")

# End of the fixed values.


@dataclass(frozen=True)
class Lexicons:
    """One set of lists; the defaults are the fixed values above."""

    labels: dict = field(default_factory=lambda: dict(LABELS))
    task: dict = field(default_factory=lambda: dict(TASKS))
    bloom: dict = field(default_factory=lambda: dict(BLOOM))
    concepts: list = field(default_factory=lambda: list(CONCEPTS))
    technical_terms: list = field(default_factory=lambda: list(TECHNICAL))
    algorithm: dict = field(default_factory=lambda: dict(ALGORITHMS))
    constraint_patterns: list = field(default_factory=lambda: list(CONSTRAINTS))
    negation: list = field(default_factory=lambda: list(NEGATIONS))
    code_signatures: list = field(default_factory=lambda: list(CODE_SIGNATURES))
    branch_keywords: list = field(default_factory=lambda: list(BRANCHES))
    loop_keywords: list = field(default_factory=lambda: list(LOOPS))
    option_markers: list = field(default_factory=lambda: list(OPTION_MARKERS))


def load(folder: str | Path) -> Lexicons:
    """The lists in the YAML files of ``folder``, a file per list named after it (``task.yaml``), or one
    ``lexicons.yaml`` with several; lists that no file has stay at their defaults, unknown names fail."""
    import yaml

    known, found = {f.name for f in fields(Lexicons)}, {}
    for path in sorted(Path(folder).glob("*.yaml")):
        content = yaml.safe_load(path.read_text(encoding="utf-8"))
        found |= content or {} if path.stem == "lexicons" else {path.stem: content or type(getattr(Lexicons(), path.stem, []))()}
    if found.keys() - known:
        raise ValueError(f"unknown_lexicons:{sorted(found.keys() - known)}")
    return replace(Lexicons(), **found)
