"""Limits, weights and word lists.

The word lists and numbers below are fixed values: results depend on every one of them.
"""

MAX_CONTENT, MAX_TAG, MAX_ENTITY, MAX_SOURCE = 8000, 100, 200, 200
MAX_TAGS, MAX_ENTITIES = 20, 50
RECALL_LIMIT, RECALL_MAX, BRIEF_CHARS = 10, 100, 240
RELATED_DEPTH, RELATED_MAX_DEPTH, RELATED_LIMIT, RELATED_MAX = 2, 5, 20, 100
SEARCH_LIMIT, SEARCH_MAX, LIST_LIMIT, LIST_MAX = 20, 100, 20, 10_000
RETENTION_LIMIT, RETENTION_THRESHOLD, IMMUNE_IMPORTANCE, IMMUNE_ACCESS, KEEP_BOOST = 20, 0.25, 4, 3, 3
LOG_LIMIT, LOG_MAX, PRUNE_LIMIT = 50, 500, 1000
SEARCH_KEYWORD, SEARCH_FTS = 0.45, 0.55
RRF_K, ANCHORS, VECTOR_ANCHOR_MIN = 60, 20, 0.1
SEMANTIC_CANDIDATE, SEMANTIC_EDGE, SEMANTIC_EDGES = 0.4, 0.8, 3
DUPLICATE_TOKENS, DUPLICATE_LENGTH, CAUSAL_OVERLAP = 0.9, 1.25, 0.15
TEMPORAL_HOURS, PROXIMITY_LINKS, ENTITY_LINKS, ENTITY_EDGES = 24, 10, 5, 50
HOT_SHARE, HOT_FLOOR, CAUSAL_LOOKBACK, DEDUP_CANDIDATES = 0.01, 20, 10, 5
LAMBDA_EDGE, LAMBDA_VECTOR, ELITE_COSINE = 1.0, 0.4, 0.85
MAX_CANDIDATES, MIN_CANDIDATES, TOP_CANDIDATES = 500, 50, 5000
CATEGORIES = ("preference", "decision", "fact", "insight", "context", "general")
EDGE_TYPES = ("temporal", "semantic", "causal", "entity")
INTENTS = ("WHY", "WHEN", "ENTITY", "GENERAL")
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "about",
    "that", "this", "it", "its", "or", "and", "but", "if", "not", "no", "so", "up",
    "out", "than", "then", "too", "very", "just", "also", "more", "some", "any", "all", "each",
    "i", "me", "my", "we", "you", "your", "he", "she", "they", "them", "his", "her",
    "our", "their", "what", "which", "who", "how", "when", "where",
)
ACRONYM_STOPWORDS = (
    "IN", "ON", "AT", "TO", "BY", "OR", "AN", "IF", "IS", "IT", "OF", "AS",
    "DO", "NO", "SO", "UP", "WE", "HE", "MY", "BE", "GO", "THE", "AND", "FOR",
    "ARE", "BUT", "NOT", "YOU", "ALL", "CAN", "HER", "WAS", "ONE", "OUR", "OUT", "HAS",
    "HAD", "HOW", "MAN", "NEW", "NOW", "OLD", "SEE", "WAY", "MAY", "SAY", "SHE", "TWO",
    "USE", "BOY", "DID", "GET", "HIM", "HIS", "LET", "PUT", "TOP", "TOO", "ANY", "OK",
    "YES", "TRUE", "FALSE", "ONLY", "BOTH", "NEVER", "ALWAYS", "MUST", "STILL", "SAME", "ALSO", "EVERY",
    "OTHER", "OWN", "REAL", "WORTH", "HARD", "FULL", "EMPTY", "ZERO", "KEEP", "SKIP", "LEFT", "WITH",
    "FROM", "THAT", "THIS", "THAN", "WHAT", "WHY", "DOES", "CANNOT", "NEEDS", "BEFORE", "AFTER", "FIRST",
    "SECOND", "THIRD", "FINAL", "THREE", "FOUR", "FIVE", "HIGH", "PASS", "FAIL", "FAILED", "FIX", "FIXED",
    "DONE", "WRONG", "STALE", "ARMED", "OPEN", "CLOSED", "FOUND", "SENT", "SAFE", "CLEAN", "VERIFY", "CHECK",
    "REVIEW", "DRAFT", "PROOF", "NOTE", "NOTES", "LESSON", "RULE", "FACT", "FACTS", "DEFECT", "CAUSE", "GOTCHA",
    "TRAP", "BUG", "ISSUE", "ERROR",
)
TECH_DICTIONARY = (
    "Go", "Rust", "Python", "Java", "Kotlin", "Swift", "Ruby", "Elixir", "Zig", "Lua", "Dart", "Scala",
    "Perl", "Haskell", "OCaml", "Julia", "Clojure", "JavaScript", "TypeScript", "React", "Vue", "Angular", "Svelte", "Next",
    "Nuxt", "Node", "Deno", "Bun", "Vite", "Webpack", "SQLite", "PostgreSQL", "Postgres", "MySQL", "Redis", "MongoDB",
    "DynamoDB", "Cassandra", "Qdrant", "Milvus", "Chroma", "Pinecone", "Neo4j", "Weaviate", "Elasticsearch", "Docker", "Kubernetes", "Terraform",
    "Ansible", "Nginx", "Caddy", "Kafka", "RabbitMQ", "AWS", "GCP", "Azure", "Vercel", "Netlify", "Cloudflare", "Supabase",
    "Firebase", "Ollama", "OpenAI", "Claude", "Anthropic", "PyTorch", "TensorFlow", "LangChain", "LlamaIndex", "FAISS", "Hugging", "Git",
    "GitHub", "GitLab", "Cobra", "FastAPI", "Flask", "Django", "Rails", "Spring", "Express", "Gin", "Echo", "Fiber",
    "Pytest", "Jest", "Vitest", "gRPC", "GraphQL", "WebSocket", "OAuth", "JWT", "YAML", "TOML", "Protobuf", "MAGMA",
    "MCP", "RLM",
)
WHY_TERMS = (
    "why", "reason", "because", "cause", "motivation", "rationale", "为什么", "原因", "理由",
)
WHEN_TERMS = (
    "when", "time", "date", "before", "after", "during", "timeline", "history", "sequence", "什么时候", "何时", "时间",
    "之前", "之后",
)
ENTITY_TERMS = (
    "what is", "who is", "tell me about", "describe", "about", "是什么", "谁是", "关于", "介绍",
)
CAUSAL_PHRASES = (
    "because", "therefore", "due to", "caused by", "as a result", "decided to", "chosen because", "so that", "in order to", "leads to", "results in", "因为",
    "所以", "由于", "导致", "因此", "决定", "为了", "以便",
)
PREVENTS_PHRASES = (
    "despite", "prevented", "prevents", "blocked", "阻止", "防止",
)
ENABLES_PHRASES = (
    "so that", "in order to", "enables", "leads to", "为了", "以便",
)
NEGATION_PHRASES = (
    "no longer", "don't", "doesn't", "never", "switched from", "instead of", "rather than", "replaced", "deprecated", "不再", "放弃", "替换",
    "取消",
)
INTENT_WEIGHTS = {
    "WHY": {"causal": 0.7, "temporal": 0.2, "entity": 0.05, "semantic": 0.05},
    "WHEN": {"causal": 0.15, "temporal": 0.65, "entity": 0.1, "semantic": 0.1},
    "ENTITY": {"causal": 0.1, "temporal": 0.05, "entity": 0.55, "semantic": 0.3},
    "GENERAL": {"causal": 0.25, "temporal": 0.25, "entity": 0.25, "semantic": 0.25},
}
#: beam, depth, visited
TRAVERSAL = {"WHY": (15, 5, 500), "WHEN": (10, 5, 400), "ENTITY": (10, 4, 400), "GENERAL": (10, 4, 500)}
