"""Word lists, patterns and thresholds that define results. Nothing here is logic."""

# Files that belong to a repository snapshot.
EXCLUDED_DIRS = ("docs", "doc", "examples", "notebooks", "assets", ".github")
EXCLUDED_FILENAMES = ("readme.md", "license", "pnpm-lock.yaml", "package-lock.json", "yarn.lock", "poetry.lock", "uv.lock")
EXTENSIONS = (".py", ".pyi", ".md", ".txt", ".yaml", ".yml", ".json", ".toml", ".cu", ".cuh", ".cc", ".cpp", ".h", ".rs")
MAX_FILE_BYTES, MAX_FILES = 200_000, 200

# Tokens and sentences.
TOKEN = "[a-z0-9][a-z0-9_-]{2,}"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{2,}"
STOPWORDS = ("with", "from", "into", "using", "section", "modules", "module", "changes", "change", "implementation", "implement")
TOPIC_STOPWORDS = (
    "a", "an", "and", "attention", "for", "from", "into", "language", "large", "learning", "models", "model", "of", "on",
    "paper", "system", "the", "to", "using", "with",
)
LIST_ITEM = r"(?m)^\s*(?:[-*•]|(?:\(?\d+[\.\)])|(?:\(?[a-zA-Z][\.\)]))\s+(.+)$"
LEADING_PHRASE = (
    r"(?i)^(?:we|our work|our method|this paper|the paper)\s+"
    r"(?:introduce|propose|present|develop|show|demonstrate|study|build|derive)\s+"
)
REFERENCE = r"(?i)\b(?:eq(?:uation)?\.?\s*\d+|algorithm\s*\d+|table\s*\d+|fig(?:ure)?\.?\s*\d+)\b"
STEP_SPLIT = r"(?i)[.;:]\s+|\s+(?:and|then|while)\s+"
CONTRIBUTION_MARKERS = (
    "we introduce", "we propose", "we present", "our contributions", "our method", "this paper", "we show",
)
TECHNICAL_MARKERS = (
    "module", "objective", "kernel", "attention", "adapter", "frozen", "alignment", "loss", "efficient", "exact",
    "routing", "encoder",
)
DIFFERENCE_MARKERS = ("instead of", "rather than", "without", "compared to", "unlike", "differs from")
PROBLEM_MARKERS = ("for ", "to ", "so that ", "while ", "which ")

# Section headings; the first marker that a heading contains decides.
HEADING_BOOSTS = (
    ("abstract", 3), ("introduction", 2), ("contributions", 5), ("our contributions", 5), ("main contributions", 5),
    ("method", 3), ("approach", 3), ("overview", 2), ("experiments", 1),
)
SECTION_KINDS = (
    ("contributions", ("contributions", "our contributions", "main contributions")),
    ("method", ("method", "methods", "approach", "architecture")),
    ("abstract", ("abstract",)),
    ("experiments", ("experiments", "evaluation", "results")),
    ("appendix", ("appendix", "supplementary", "implementation details")),
)

# Tags and change types of source files, by substring of the lower-cased path and content.
SEMANTIC_TAGS = (
    ("attention", ("attention", "attn", "qkv")),
    ("adapter", ("adapter", "lora", "rank")),
    ("loss", ("loss", "objective", "reward", "preference")),
    ("training", ("trainer", "optimizer", "warmup", "scheduler", "train")),
    ("kernel", ("kernel", "triton", "cuda", "fused")),
    ("data", ("dataset", "dataloader", "tokenizer", "preprocess")),
    ("inference", ("decode", "generate", "inference", "sampling")),
)
CHANGE_TYPES = (
    ("MODIFIED_LOSS", ("loss", "reward", "preference", "logits")),
    ("MODIFIED_TRAIN", ("train", "trainer", "optimizer", "finetune")),
    ("MODIFIED_INFRA", ("docker", "workflow", "infra", "config", "script")),
)
LANGUAGES = ((("py", "pyi"), "python"), (("cu", "cuh"), "cuda"), (("cc", "cpp", "h"), "cpp"), (("rs",), "rust"), (("json",), "json"), (("md", "txt"), "text"))

# Repository addresses.
REPO_URL = r"https?://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:\.git)?"
HTTP_URL = r"https?://[^\s<>()\"']+"
URL_TAIL = ").,;:!?]}>\"'"
BASE_DECLARATIONS = ("based on", "built on", "builds on", "as a base", "as the base", "extends", "derived from")
STRATEGY_PRIORITY = (
    ("github_fork", 5), ("readme_base_declaration", 5), ("readme_declaration", 4), ("framework_signature", 4),
    ("fossil_evidence", 4), ("metadata_url", 4), ("paper_mention", 3), ("dependency_archaeology", 3),
    ("citation_graph", 3), ("author_graph", 3), ("temporal_topic_search", 3), ("github_code_search", 3),
    ("shape_similarity", 3), ("llm_reasoning", 2), ("code_reference", 2), ("code_fingerprint", 2), ("fallback", 1),
)
LOCAL_STRATEGIES = (
    "github_fork", "readme_declaration", "framework_signature", "fossil_evidence", "metadata_url",
    "dependency_archaeology", "code_reference", "code_fingerprint", "shape_similarity",
)
SURNAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "dr", "prof")

# Scores and limits.
TOP_K, MIN_SCORE, RELATIVE_FLOOR = 5, 0.08, 0.6
FINGERPRINT_FLOOR, SHAPE_FLOOR = 0.12, 0.2
AMBIGUOUS_MARGIN, MOVED_FLOOR, LOW_FLOOR = 0.08, 0.55, 0.40
LARGE_LINES, LARGE_BYTES = 5000, 524_288
PARSE_SECTIONS, PARSE_SECTION_CHARS, PARSE_TOTAL_CHARS, PARSE_BATCHES, PARSE_LEAST = 8, 3500, 14_000, 3, 200
BUCKETS = ("primary", "added", "deleted", "ambiguous", "low_confidence", "other_languages", "large_files")
PRIMARY_LANGUAGES = ("python",)

# Known upstream repositories.
UPSTREAM_ALIASES = (
    ("transformers", "https://github.com/huggingface/transformers"),
    ("huggingface/transformers", "https://github.com/huggingface/transformers"),
    ("trl", "https://github.com/huggingface/trl"),
    ("huggingface/trl", "https://github.com/huggingface/trl"),
    ("triton", "https://github.com/openai/triton"),
    ("openai/triton", "https://github.com/openai/triton"),
)
DEPENDENCY_REPOS = (
    ("transformers", "https://github.com/huggingface/transformers"),
    ("trl", "https://github.com/huggingface/trl"),
    ("triton", "https://github.com/openai/triton"),
    ("fairseq", "https://github.com/facebookresearch/fairseq"),
    ("peft", "https://github.com/huggingface/peft"),
    ("accelerate", "https://github.com/huggingface/accelerate"),
)
FRAMEWORKS = (
    ("https://github.com/huggingface/transformers", ("transformers", "AutoModelForCausalLM", "PreTrainedModel", "from_pretrained"),
     ("PreTrainedModel", "PretrainedConfig", "PreTrainedTokenizer"), ("src/transformers/models",)),
    ("https://github.com/huggingface/trl",
     ("trl", "DPOTrainer", "PPOTrainer", "SFTTrainer", "GRPOTrainer", "GRPOConfig", "TrlParser", "reward_trainer", "GOLDConfig"),
     ("DPOTrainer", "PPOTrainer", "SFTTrainer", "GRPOTrainer"), ("trl/trainer", "trl/experimental/gold")),
    ("https://github.com/openai/triton", ("triton", "triton.language", "triton.jit"), (), ("python/triton",)),
    ("https://github.com/facebookresearch/fairseq", ("fairseq", "register_model", "register_task", "FairseqCriterion"),
     ("BaseFairseqModel", "FairseqCriterion", "FairseqTask"), ("fairseq_cli", "criterions")),
)
METADATA_CONFIDENCE = ((".gitmodules", 0.95), (".git/config", 0.9), ("citation.cff", 0.86), ("citation.bib", 0.86))
METADATA_DEFAULT = 0.82

# Formula concepts, in papers and in code.
PAPER_CONCEPTS = (
    ("attention", ("attention", "qkv", "kv-cache")),
    ("cache", ("cache", "cached")),
    ("cross_entropy", ("cross entropy", "nll", "negative log-likelihood")),
    ("fused_kernel", ("kernel", "fused", "cuda", "triton")),
    ("kl", ("kl", "kullback", "divergence", "kl-div")),
    ("low_rank", ("low-rank", "rank decomposition", "rank-deficient")),
    ("preference", ("preference", "chosen", "rejected", "pairwise")),
    ("sigmoid", ("sigmoid", "log-sigmoid", "log sigmoid")),
    ("softmax", ("softmax", "log-softmax", "log softmax")),
    ("temperature", ("temperature", "beta")),
)
CODE_CONCEPTS = (
    ("attention", ("attention", "attn", "qkv")),
    ("cache", ("cache", "cached")),
    ("cross_entropy", ("cross_entropy", "crossentropy", "nll_loss", "nll")),
    ("fused_kernel", ("kernel", "triton", "cuda", "fused")),
    ("kl", ("kl_div", "kldiv", "kl", "divergence")),
    ("low_rank", ("lora", "low_rank", "rank", "adapter")),
    ("preference", ("preference", "chosen", "rejected", "pairwise")),
    ("sigmoid", ("sigmoid", "logsigmoid")),
    ("softmax", ("softmax", "log_softmax")),
    ("temperature", ("temperature", "beta")),
)
SIGNATURES = (
    ("C1", "Low-rank adaptation modules", ("low-rank", "adapter", "rank-decomposition"),
     ("low-rank", "rank decomposition", "adapter", "adaptation matrices")),
    ("C2", "Frozen backbone fine-tuning", ("frozen", "backbone", "trainable"),
     ("frozen", "freeze", "pretrained weights", "trainable parameters")),
    ("C1", "Direct preference optimization objective", ("preference", "objective", "alignment"),
     ("direct preference optimization", "preference objective", "reward model", "preference data")),
    ("C1", "IO-aware fused attention kernel", ("io-aware", "attention", "kernel"),
     ("io-aware", "exact attention", "fused attention", "attention kernel", "tiling")),
)
