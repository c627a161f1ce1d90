"""Values that results depend on: word lists, patterns, thresholds, messages."""

# Characters and word lists of line repair.
WORD_CLASS = "[a-zA-Z0-9À-ÖØ-öø-ÿ]"
HYPHENS = "-‐‑­"
PREFIXES = (
    "ex", "vice", "vizo", "soto", "pré", "pre", "pós", "pos", "pró", "pro", "recém", "recem", "além", "alem", "aquém", "aquem", "sem", "self", "all", "well", "cross", "half",
)
VOWEL_PREFIXES = (
    "auto", "anti", "contra", "micro", "macro", "mini", "multi", "neo", "proto", "pseudo", "semi", "infra", "supra", "ultra", "extra", "intra",
)
ENCLITICS = (
    "me", "te", "se", "nos", "vos", "o", "a", "os", "as", "lhe", "lhes", "lo", "la", "los", "las", "no", "na", "nas", "mo", "ma", "mos", "mas", "to", "ta", "tos", "tas", "lho", "lha", "lhos", "lhas",
)
COMPOUNDS = (
    "guarda-chuva", "guarda-roupa", "guarda-noturno", "guarda-sol", "guarda-costas", "guarda-po", "guarda-pó", "guarda-florestal", "arco-iris", "arco-íris", "beija-flor", "couve-flor",
    "segunda-feira", "terca-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "fim-de-semana", "fim-de-tarde", "bem-vindo", "bem-estar", "bem-sucedido", "bem-nascido", "bem-criado",
    "mal-estar", "mal-humorado", "mal-intencionado", "porta-malas", "porta-voz", "porta-bandeira", "porta-retrato", "porta-avioes", "porta-aviões", "porta-joias",
    "medico-cirurgiao", "médico-cirurgião", "historico-geografico", "histórico-geográfico", "politico-economico", "político-econômico", "fisico-quimico", "físico-químico", "social-democrata",
    "norte-americano", "sul-americano", "centro-americano", "afro-brasileiro", "luso-brasileiro", "bate-papo", "quebra-cabeca", "quebra-cabeça", "para-raios", "pára-raios", "pingue-pongue", "tique-taque",
    "state-of-the-art", "high-level", "low-level", "well-known", "real-time", "open-source", "built-in", "first-class", "end-to-end", "user-facing", "read-only", "set-up", "clean-up", "front-end", "back-end",
)

# Patterns of block classification and rendering; those of code count without regard to case.
CODE_LINES = (
    r"^(def\s+\w+\s*\(|class\s+\w+[:\(]|import\s+[a-zA-Z_]\w*|from\s+[a-zA-Z_]\w*\s+import\s+)",
    r"^(function\s+\w+\s*\(|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=)",
    r"^(return(\s+[^.!?]+)?(;)?$|return\s+.*;$|console\.log\(|print\()",
    r"^(public\s+(static\s+)?(void|class|int|String|boolean)|#include\s+<)",
    r"^(SELECT\s+.+\s+FROM\s+|INSERT\s+INTO\s+|CREATE\s+TABLE\s+)",
    r"^[{}\[\]();]+,?$",
    r".*[{};]\s*,?\s*$",
    r"^\s*</?[a-zA-Z][\w.:-]*(?:\s+[^>]*)?/?>?\s*$",
    r"^\s*<[a-zA-Z][\w.:-]*(\s+[^>]*)?>.*</[a-zA-Z][\w.:-]*>\s*$",
    r"^\s*\{/\*.*?\*/\}\s*$",
    r"^\s*\{[a-zA-Z0-9_.]+(?:\s*===|\s*!==|\s*&&\s*|\.map\(|\.filter\(|\.reduce\().*",
    r"\b(className|onClick|onChange|onSubmit|aria-\w+|style|htmlFor|href|target|rel|type|id|name|value|placeholder|key|src|alt)=[\"'{]",
    r"^\s*(export\s+(default\s+)?(const|function|class|default)?|import\s+.*?\s+from)\b",
    r"^\s*(<>|</>|/>|>)\s*$",
    r"^\s*(/\*+|\*/|//.*|\*\s*@\w+|\*\s+[a-zA-Z_]\w*\s*-)",
    r"^\s*\$\{[^}]*",
    r"^\s*[?:].*['\"`]",
    r"^\s*\{.*:\s*.*\}?,?\s*$",
    r"^\s*[a-zA-Z_]\w*(\s*=\s*[^,]+)?,\s*$",
)
FILENAME = r"^(?:[0-9]️?⃣|\d+[\.\)]|[A-Za-z][\.\)]|\W+)?\s*[\w\.\-]+\.(?:jsx?|tsx?|py|html|css|json|md)\s*$"
TAG_OPEN = r"<([a-zA-Z][\w.:-]*)(\s+[^>]*)?>\s*$"
TAG_CLOSE = r"^\s*</([a-zA-Z][\w.:-]*)>"
BULLET = r"^([-*+•◦▪▫–—])\s+"
ORDINAL = r"^(\d+[\.\)]|\([0-9]+\)|[a-zA-Z][\.\)]|[ivxlcdmIVXLCDM]+[\.\)])\s+"
CHAPTER = r"^(Capítulo|Capitulo|Chapter|Parte|Part)\b"
SECTION = r"^(Seção|Secao|Section|Anexo|Apêndice|Apendice|Appendix)\b"
HASHES, OUTLINE, SINGLE, KEYCAP = r"^(#{1,})\s+(.+)$", r"^(\d+(?:\.\d+)+)\.?\s+(.+)$", r"^(\d+)(?:\.|\s+-|\s+–)\s+(.+)$", r"^([0-9]️?⃣)\s+(.+)$"
JSDOC, JSDOC_TERM = r"^(\* @|/\*|\*/)", r"^\*\s+[a-zA-Z_]\w*\s*-"
LIST_BULLET = r"^(\s*)([-*+•◦▪▫–—])\s+(.+)$"
LIST_ORDERED = (r"^(\s*)(\d+)[\.\)]\s+(.+)$", r"^(\s*)\((\d+)\)\s+(.+)$", r"^(\s*)([a-zA-Z]|[ivxlcdmIVXLCDM]+)[\.\)]\s+(.+)$")
TAG_LIKE = r"<(?=/?(?:[a-zA-Z][\w.:-]*)(?:\s|>|/|$))"
MAX_HEADING = 150

# Quality thresholds and the messages of a report.
MAX_CORRUPTION, MIN_READABLE_CHARS, MIN_READABLE, MAX_SAMPLE = 0.15, 30, 0.80, 5
REASON_FORCED = "Extração OCR forçada manualmente via parâmetro force_ocr."
REASON_CORRUPT = "Taxa de corrupção textual (%.1f%%) excede o limiar máximo permitido (15.0%%)."
REASON_EMPTY = "Nenhum caractere textual detectado nas páginas amostradas."
REASON_SPARSE = "Densidade textual insuficiente (%d caracteres legíveis, mínimo 30)."
REASON_UNREADABLE = "Taxa de caracteres legíveis (%.1f%%) está abaixo do limiar mínimo (80.0%%)."
REASON_NATIVE = "Camada textual íntegra detectada (%d caracteres legíveis, legibilidade de %.1f%%)."

NATIVE, OCR = "native_text", "ocr_fallback"
BLOCK_TYPES = ("paragraph", "heading", "code_block", "list_item", "table")
FORMATS = ("md", "markdown", "html", "html5")
