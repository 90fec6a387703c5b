"""What to look for and how to weigh it.

Everything that names a product, a host, a word list, a weight or a cap lives in
one frozen ``UsageSpec``.  Operators fold it into column literals, so Catalyst sees
constants and the tasks never need the object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

# --- fixed values -----------------------------------------------------------

REPO_HOST = "github.com"

MANIFEST_NAMES = ("package.json", "requirements.txt", "pyproject.toml")
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "mjs")
PATH_HINTS = (
    "pipeline", "integration", "agent", "engine", "config", "api", "route",
    "server", "main", "index", "app", "relay", "deploy",
)
DIGEST_PATH_HINTS = (
    "pipeline", "integration", "agent", "engine", "config", "api", "route",
    "server", "main", "index", "app",
)
CALL_STRINGS = ("client.use", "client.send", "client.chat")
CALL_TOKENS = ("client.use", "client.chat", "client.send", "client.connect")
ENGINE_MARKERS = ("ws://localhost:5565", "/v1/pipelines")
PLATFORMS = (
    "butterbase", "supabase", "xtrace", "photon", "langchain",
    "crewai", "firebase", "pinecone", "weaviate",
)
COMPETING_RUNTIMES = ("langchain", "crewai")

FIELDS = ("project", "names", "emails", "github", "feedback", "demo", "deployed")
HEADER_ALIASES = {
    "project": ("projecttitle", "projectname", "project", "name", "title"),
    "names": ("teammembersnamesall", "teammembersnames", "names", "teammembers", "teamname"),
    "emails": ("teammembersemailsall", "teammembersemails", "teamemails", "emails", "email"),
    "github": (
        "githubrepo", "githuburl", "githublink", "github", "gitlink", "gitrepo",
        "gitrepository", "gitrepolink", "repository", "repolink", "repositoryurl",
        "repo", "codelink",
    ),
    "feedback": ("feedback",),
    "demo": (
        "videodemopresentation", "demopresentation", "demovideo", "demo",
        "presentation", "video",
    ),
    "deployed": (
        "deployedprojecturl", "deployedurl", "liveappurl", "liveapp", "livelink",
        "liveurl", "hostedurl", "deployment",
    ),
}
LABEL_HINTS = ("name", "team", "project", "title", "group", "submission")

TAGS = ("Significant", "Moderate", "Less", "None")
TAG_COLOURS = {"Significant": "C6EFCE", "Moderate": "FFEB9C", "Less": "FCE4D6", "None": "FFC7CE"}
BACKBONE_COLOURS = {"Yes": "C6EFCE", "Partial": "FFEB9C", "No": "E7E6E6"}
LAYERS = ("ingest", "retrieval", "orchestration", "reasoning", "output")

VERDICT_MARKERS = ('"tag"', "Significant", "Moderate", '"backbone"', '"repo_accessible"')
MONITOR_SECONDS = 150

NEEDS_REVIEW_HEADERS = {
    "project": "Project title",
    "names": "Team Members Names",
    "emails": "Team Members Emails",
    "github": "Github Repo",
    "feedback": "Feedback",
}

# --- weights, thresholds, caps ----------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Points per signal.  All are multiples of 0.5, so sums in DOUBLE are exact."""

    dependency: float = 1.0
    called: float = 2.0
    agent: float = 1.0
    complexity_mid: float = 0.5
    complexity_high: float = 1.0
    tool_or_llm: float = 0.5
    hosted: float = 1.0
    callsites: float = 0.5
    spread: float = 0.5
    uncalled: float = -1.0


@dataclass(frozen=True)
class Thresholds:
    significant: float = 4.0
    moderate: float = 2.0
    less: float = 1.0
    mid_nodes: int = 4
    high_nodes: int = 9
    callsites: int = 3
    spread: int = 2


@dataclass(frozen=True)
class Caps:
    """How much is shown, how far headers are looked for; ``definitions``, ``manifests`` and ``sources``
    are the sizes of the selection in ``select_files``.  Evidence and verdicts have no caps."""

    definitions: int = 12
    manifests: int = 8
    sources: int = 28
    call_sites: int = 6
    shown_sites: int = 3
    source_signals: int = 20
    digest_definitions: int = 8
    snippet_chars: int = 110
    header_rows: int = 8
    sample_rows: int = 30
    label_values: int = 8
    attempts: int | None = None  # replies that count per item; none: all


@dataclass(frozen=True)
class UsageSpec:
    """One product to measure.  Build it with :meth:`for_product`."""

    product: str
    title: str
    call_tokens: tuple[str, ...]
    import_markers: tuple[str, ...]
    hosted_markers: tuple[str, ...]
    source_patterns: tuple[str, ...]
    path_hints: tuple[str, ...]
    digest_path_hints: tuple[str, ...]
    scaffold_suffix: str
    definition_suffix: str = ".pipe"
    definitions_folder: str = "pipelines"
    call_strings: tuple[str, ...] = CALL_STRINGS
    engine_markers: tuple[str, ...] = ENGINE_MARKERS
    platforms: tuple[str, ...] = PLATFORMS
    competitors: tuple[str, ...] = COMPETING_RUNTIMES
    manifest_names: tuple[str, ...] = MANIFEST_NAMES
    source_extensions: tuple[str, ...] = SOURCE_EXTENSIONS
    host: str = REPO_HOST
    host_regex: str = re.escape(REPO_HOST)
    verdict_markers: tuple[str, ...] = VERDICT_MARKERS
    weights: Weights = field(default_factory=Weights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    caps: Caps = field(default_factory=Caps)

    @classmethod
    def for_product(cls, product: str, title: str | None = None, path_hint: str | None = None):
        """Derive every product-specific token from the product's name.

        ``product`` is the lowercase package name, ``title`` the spelling used in
        class names and prose, ``path_hint`` a path fragment that marks likely
        integration files (defaults to the package name).
        """
        p = product.lower()
        title = title or product
        hint = path_hint or p
        return cls(
            product=p,
            title=title,
            call_tokens=(f"{title}Client", *CALL_TOKENS),
            import_markers=(f"from {p}", f"import {p}", f"@{p}"),
            hosted_markers=(f"{p}_pipeline", f"lib/{p}"),
            # fixed values, in report order
            source_patterns=(
                f"{p}client", "client.use(", "client.chat(", "ws://localhost:5565",
                "/v1/pipelines", f"@{p}/sdk", f"from {p}", f"import {p}",
                f"require('{p}", f'require("{p}',
                f"{p}_pipeline", f"{p}_api_key", f"{p}_apikey", f"{p}_uri",
                f"lib/{p}", f"/{p}'", f'/{p}"',
            ),
            path_hints=(hint, *PATH_HINTS),
            digest_path_hints=(hint, *DIGEST_PATH_HINTS),
            scaffold_suffix=f".claude/rules/{p}.md",
        )

    def with_(self, **changes) -> UsageSpec:
        return replace(self, **changes)

    # --- regexes, written for Java's engine with Unicode classes (?U) --------

    @property
    def call_regex(self) -> str:
        return r"(?iU)\b(?:" + "|".join(re.escape(t) for t in self.call_tokens) + ")"

    @property
    def manifest_regex(self) -> str:
        return "(^|/)(" + "|".join(re.escape(n) for n in self.manifest_names) + ")$"

    @property
    def source_regex(self) -> str:
        return r"\.(" + "|".join(self.source_extensions) + ")$"

    @property
    def hint_regex(self) -> str:
        return "(?i)" + "|".join(re.escape(h) for h in self.path_hints)

    @property
    def digest_hint_regex(self) -> str:
        return "(?i)" + "|".join(re.escape(h) for h in self.digest_path_hints)

    # --- output texts ---------------------------------------------------------

    @property
    def sheet_headers(self) -> dict[str, str]:
        """Sheet column -> printed header (fixed values, in sheet order)."""
        return {
            "project_name": "Project Name",
            "team_details": "Team Details (Names / Emails)",
            "description": "Project Description",
            "usage": f"How {self.title} Was Used & How It Helped",
            "usage_tag": f"{self.title} Usage Tag",
            "backbone": f"{self.title} = Backbone?",
            "repo_link": "GitHub Link",
            "notes": "Additional Notes",
            "justification": "Why This Classification (Justification)",
            "demo": "Demo / Presentation / Video",
            "deployed": "Deployed URL",
            "score": "Score",
            "called_total": "Pipelines (Called / Total)",
            "evidence": "Pipeline Evidence (Ground Truth)",
        }

    @property
    def route_texts(self) -> dict[str, tuple[str, str]]:
        """Route -> (notes, justification); ``%s`` takes the status or the note (fixed values)."""
        return {
            "no_repo": (
                "No GitHub repo provided — flag for correction; scored as ZERO",
                f"No GitHub repository was provided in the submission, so {self.title} usage "
                "cannot be verified from code — classified None / No and flagged for correction "
                "(score zero).",
            ),
            "inaccessible": (
                "INACCESSIBLE (HTTP %s) — flag for correction: double-check the repo URL; "
                "scored as ZERO",
                f"The repository could not be accessed (HTTP %s), so {self.title} usage cannot "
                "be verified from code — classified None / No and flagged for correction "
                "(score zero).",
            ),
            "incomplete": (
                "Evidence fetch incomplete (%s) — resubmit this row",
                "Evidence gathering was incomplete this run, so classification was deferred — "
                "resubmit this row.",
            ),
        }

    # fixed values
    TREE_NOTE = "tree fetch failed (HTTP %s)"
    PROSE_MISSING = (
        " (Plain-English explanation unavailable this run — the deterministic verdict stands; "
        "see the evidence table.)"
    )
    PROSE_PENDING = " [explanation pending — cloud classifier unreachable]"
    WORKER_ERROR = "worker error: "
