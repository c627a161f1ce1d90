"""Problem 9: notebooks that hold template residue, filler or error pages and nothing else.

Two character n-gram models are fitted: one of residue (unfilled slots, prompts to write something, filler,
messages and notices), one of content (prose, code, output). Their log-likelihood ratio over windows of a line
localises residue; a notebook is excluded if the residue covers all that stands where content should.

The models are counts of n-grams in BUCKETS hashed buckets, fitted on all notebooks, whole: first from SEEDS and lines labelled by rule,
then again from the lines of the notebooks that the first model finds to be residue or content. Counting is distributed: a task sends one
vector of counts, and only their sum comes back. All notebooks are scored, whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchflow.runtime import arrow_map, ship

BITS = 20
BUCKETS = 1 << BITS
N, WINDOW, COVERAGE = 4, 48, 0.75

# Texts of residue, by kind, written for this project.
SEEDS = """
Error 404 Not Found|Error 500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout|403 Forbidden|401 Unauthorized|429 Too Many Requests
<html><head><title>404 Not Found</title></head>|<body><center><h1>503 Service Unavailable</h1></center><hr><center>nginx</center></body></html>|proxy/1.18|server/2.4
The requested page was not found on this server.|The page you are looking for does not exist or has been moved.|Oops! Something went wrong. Please try again later.|Reference: 482915|Go back to the start page.
Rate limit reached. Try again in 20 minutes.|Too many requests, please slow down.|Your session has expired. Sign in again to continue.|Please log in to view this page.|You must be signed in to open this file.
Access denied. Ask the owner for permission.|You do not have permission to view this notebook.|This repository has been disabled or removed.|This file is no longer available.|Sorry, this notebook could not be rendered.
Sorry, something went wrong. Reload?|Unable to render rich display|An error occurred while loading the file.|There was an error rendering your notebook.|Invalid notebook.|The viewer could not load this document.|This file is too big to display.
You need to enable JavaScript to run this app.|Please enable JavaScript in your browser to continue.|This site requires JavaScript. Turn it on and reload the page.|JavaScript is disabled. Enable scripts to view the notebook.|If nothing happens, turn on scripting in the settings and reload.
Loading … please wait|Kernel starting, please wait...|Connecting to kernel|Checking your browser before accessing the site.|Redirecting you to the login page.|Cookies must be enabled.
Esta aplicación requiere JavaScript. Actívelo y vuelva a cargar la página.|Ative o JavaScript no seu navegador para continuar.|Veuillez activer JavaScript pour afficher cette page.|Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.|Per continuare attivare JavaScript nel browser.|Включите JavaScript в браузере, чтобы продолжить.
{"status": 404, "error": "Not Found", "path": "/index.html"}|{"message": "Forbidden", "code": 403}|Erro 403: a página solicitada não existe ou foi movida.|Código 685504|Error code: 500|Fehlercode 403|Code d'erreur 404|nginx-proxy/1.25
Página não encontrada|Erro 404 – a página não foi encontrada.|Error 500 – no se encontró la página.|Fehler 404 – Die Seite wurde nicht gefunden.|Erreur 404 – la page est introuvable.|Errore 404 – la pagina non è stata trovata.|Ошибка 404 – страница не найдена.
Sua sessão expirou. Entre novamente.|Su sesión ha caducado. Inicie sesión de nuevo.|Votre session a expiré. Reconnectez-vous.|Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.|La sessione è scaduta. Accedi di nuovo.|Сеанс истёк. Войдите снова.
Type your description here|Double-click to write your answer here|Write your answer here, replacing this text.|YOUR ANSWER HERE|YOUR CODE HERE|your code here|# YOUR CODE HERE|# YOUR ANSWER HERE|raise NotImplementedError|raise NotImplementedError()|Enter text here|Add a description|Insert title here|Describe your data here|TODO write something|Answer:|Coming soon|Under construction|To be completed|TBD|Replace this text with your own.
Digite seu texto aqui|Escreva sua resposta aqui|Resposta:|Em breve|Escriba aquí su texto|Escriba su respuesta aquí|Respuesta:|Próximamente|Écrivez votre texte ici|Réponse :|Hier Text eingeben|Antwort:|Demnächst|Scrivi qui il tuo testo|Risposta:|Введите текст здесь|Ответ:|Скоро
undefined|null|NaN|[object Object]|None|#REF!|#N/A|#VALUE!|#DIV/0!|Title: undefined|Author: null|Updated:|Body: [object Object]|Date: Invalid Date|Name: null
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.|Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.|Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.|Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Author: {{ author }}|By {{ name }}|Autor: {{ author }}|{{ summary }}|${DESCRIPTION}|By ${OWNER}|%(intro)s|By %(owner)s|<%= intro %>|Autor: <%= owner %>|<your name>|By <your name>|<short description>|[Your Name]|Prepared by {{ author }} on {{ date }} for {{ client }}.|This notebook was made by {{ author }} on {{ date }} for {{ client }}.|Preparado por {{ autor }} em {{ data }} para {{ cliente }}.|Dear {{ name }}, welcome to {{ project }}.|Hecho por {{ autor }} el {{ fecha }}.|Fait par {{ auteur }} le {{ date }}.|Erstellt von {{ autor }} am {{ datum }}.|Answer: ______|Date: ________|______
"""  # fmt: skip
SLOT = re.compile(r"\{\{[^{}\n]*\}\}|\{%[^{}\n]*%\}|\$\{[^{}\n]*\}|%\(\w+\)[sd]|<%=?[^%\n]*%>|<(?:your |short |insert |add )[^<>\n]*>|\[(?:Your|your|Insert|insert|Add|add) [^\]\n]*\]|_{4,}|<[a-z]{3,12}>(?=\s*$)|\b__[A-Z][A-Z_]*__\b|#?(?<![\w$%])\{[A-Za-z_]\w*\}|\[\[[^\[\]\n]*\]\]|<<[^<>\n]*>>|@@\w+@@|(?<!\w)%[A-Za-z_]\w*%|\[[A-Z][A-Z _]+\]")
STUB = re.compile(r"\s*(?:pass|\.\.\.|raise NotImplementedError(?:\([^)]*\))?|#\s*(?:your code here|your answer here|todo\b.*|assignment\b.*|solution here.*)|answer = None)\s*", re.I)
PROMPT = re.compile(r"your (?:code|answer) here|NotImplementedError", re.I)
HEADING = re.compile(r"\s*#{1,6}(?:\s|$)|\s*<h[1-6]>[^<]*</h[1-6]>\s*$")
CELL = re.compile(r"#\s*%%")
FENCE = re.compile(r"\s*(?:```|~~~)")
TOKEN = re.compile(r"[^\W\d_]+")


def cells(text: str, kind: str | None) -> list[tuple[bool, str]]:
    """(whether it is code or output, content) of each cell; text that isn't in the format named is one cell of prose."""
    if kind == "ipynb" or text.startswith('{"cells"'):
        try:
            out = []
            for c in json.loads(text)["cells"]:
                s = c.get("source", "")
                out.append((c.get("cell_type") != "markdown", "".join(s) if isinstance(s, list) else str(s)))
            return out
        except (ValueError, KeyError, TypeError, AttributeError):
            pass
    out, code, lines = [], False, []
    fenced = kind == "markdown"
    for line in text.split("\n"):
        if not fenced and CELL.match(line):
            out.append((code, "\n".join(lines)))
            code, lines = "[markdown]" not in line, []
        elif fenced and FENCE.match(line):
            out.append((code, "\n".join(lines)))
            code, lines = not code, []
        else:
            lines.append(line)
    return [*out, (code, "\n".join(lines))]


def units(text: str, kind: str | None) -> list[tuple[str, str]]:
    """(role, line) of the lines that aren't blank: 'stub' and 'head' stand for no content, 'code' and 'text' may."""
    out = []
    for code, cell in cells(text, kind):
        for line in cell.split("\n"):
            if not line.strip():
                continue
            if code:
                out.append(("stub" if STUB.fullmatch(line) else "code", line.strip()))
            else:
                out.append(("head" if HEADING.match(line) else "text", line.strip()))
    return out


_SLOT_MARKS = re.compile(r"\$\{|\{[{%A-Za-z_]|<[%<a-z]|\[[A-Zyia\[]|@@|%[(A-Za-z_]|__")  # a slot holds one of these


def slotted(line: str) -> bool:
    """Whether a line holds a slot."""
    return bool(_SLOT_MARKS.search(line) and SLOT.search(line))


#: A run of encoded data, as of an embedded image. Its n-grams are as many as there are data: they would fill the buckets, each too rare to be known as content.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{64,}={0,2}")


def shape(line: str) -> str:
    """A line as the models read it: slots and digits are one character each, as are those of encoded data, case is kept, ends are marked."""
    if len(line) >= 64:
        line = ENCODED.sub(lambda m: "\x04" * len(m[0]), line)
    if _SLOT_MARKS.search(line):
        line = SLOT.sub("\x02\x02\x02\x02", line)
    return f"\x01{line}\x03"


#: Characters hashed at a time, and characters of lines taken together: so arrays stay in the cache.
BLOCK, CHARS = 1 << 15, 1 << 18


class Grams:
    """Bucket of each n-gram of some lines, in one array, and where lines begin; every line has at least one."""

    def __init__(self, lines: list[str]):
        shapes = [x if len(x) >= N else x.ljust(N, "\x03") for x in map(shape, lines)]
        length = np.fromiter(map(len, shapes), np.int64, len(shapes))
        code = np.frombuffer("".join(shapes).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = length - (N - 1)
        self.start = np.cumsum(length) - length
        self.hashed = np.empty(max(0, len(code) - N + 1), np.int32)  # with those that run into the next line
        for i in range(0, len(self.hashed), BLOCK):
            part = code[i : i + BLOCK + N - 1].astype(np.uint64)
            part[part - np.uint64(48) <= 9] = 48
            m = len(part) - N + 1
            h = part[:m].copy()
            for k in range(1, N):
                h *= np.uint64(0x100000001B3)
                h += part[k : k + m]
            h *= np.uint64(0x9E3779B97F4A7C15)
            self.hashed[i : i + m] = h >> np.uint64(64 - BITS)

    @property
    def bucket(self) -> np.ndarray:
        whole = np.ones(len(self.hashed), bool)
        for k in range(1, N):
            whole[self.start[1:] - k] = False
        return self.hashed[whole]


class Model:
    """log-likelihood ratio of n-grams, residue against content, each smoothed by its share of unseen grams."""

    def __init__(self, residue: np.ndarray, content: np.ndarray):
        seen = (residue > 0) | (content > 0)
        size = int(seen.sum()) + 1
        a, b = 0.02, 0.2
        r, c = residue.sum() + a * size, content.sum() + b * size
        ratio = np.where(seen, np.log((residue + a) / r) - np.log((content + b) / c), 0.0)
        self.ratio = (np.round(ratio * 2**16) / 2**16).astype(np.float32)  # so sums are exact and don't hang on what is summed before

    def _sums(self, g: Grams) -> np.ndarray:
        out = np.zeros(len(g.hashed) + 1)
        np.cumsum(self.ratio[g.hashed], dtype=np.float64, out=out[1:])
        return out

    def windows(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters in residue windows, all characters) of each line."""
        g = Grams(lines)
        total = self._sums(g)
        parts = -(-g.size // WINDOW)
        line = np.repeat(np.arange(len(g.size)), parts)
        i = (np.arange(len(line)) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOW
        n, at = g.size[line], g.start[line]
        lo, hi = np.maximum(0, np.minimum(i, n - WINDOW)), np.minimum(i + WINDOW, n)
        bad = (total[at + hi] - total[at + lo]) > 0
        return np.bincount(line, weights=np.where(bad, hi - i, 0), minlength=len(lines)), g.size.astype(float)

    def score(self, lines: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each line."""
        g = Grams(lines)
        total = self._sums(g)
        return total[g.start + g.size] - total[g.start]


FUNCTION_WORDS = frozenset(
    "the a of in on with without for and but that when because although while since o os as de do da no na com sem por para sobre e mas que quando porque el la los las del en y pero cuando le les du avec dans et mais quand il lo gli di con per ma der die das den mit ohne durch für und aber wenn и в на с без по для о про но что когда за под сквозь через спустя между после против пока хотя также как потому так до от из у к это не".split()
)


def counts(lines: list[str]) -> np.ndarray:
    return np.bincount(Grams(lines).bucket, minlength=BUCKETS)


def spans(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Where to divide texts so that those taken together have about CHARS characters; no text is divided."""
    begin = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= CHARS or i == len(texts):
            yield begin, i
            begin, size = i, 0


def flat(lists: Iterable[list[str]]) -> list[str]:
    return [x for lines in lists for x in lines]


def seeds() -> list[str]:
    return [s for line in SEEDS.strip().split("\n") for s in line.split("|")]


def by_rule(us: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(lines of filler, lines of content) of a notebook, by rule: text in sentences without a function word is filler; code, and text with function words, is content, with the lines around it that hold slots."""
    filler, content, slots = [], [], []
    for role, x in us:
        if role == "code":
            if not slotted(x):
                content.append(x)
        elif role == "text":
            ws = TOKEN.findall(x)
            known = sum(w in FUNCTION_WORDS for w in map(str.lower, ws))
            if len(ws) >= 6 and x[-1] in ".!?" and not known and not re.search(r"\d|[a-z]\s+[A-Z]", x):
                filler.append(x)
            elif slotted(x):
                slots.append(x)
            elif known >= 2 and len(ws) >= 6:
                content.append(x)
    return filler, content + slots if content else []


#: Buckets in a row of the sums that tasks send.
SLOT_SIZE = 1 << 12


def _rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """(slot, counts) of both models, in integers no wider than they need be."""
    packed = [x.astype(np.min_scalar_type(int(x.max()))).tobytes() for x in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["slot", "n"])


def _unpacked(n: bytes) -> np.ndarray:
    return np.frombuffer(n, f"u{len(n) // (2 * SLOT_SIZE)}").reshape(2, SLOT_SIZE).astype(np.int64)


def _counted(documents: DataFrame, pick: Callable[[list[list[tuple[str, str]]]], tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of two kinds of lines of all documents (text, nb_format), pick giving both kinds from the units of some documents."""
    ship(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts, kinds = (batch.column(i).to_pylist() for i in (0, 1))
            for i, j in spans(texts):
                for total, lines in zip(sums, pick([units(t, k) for t, k in zip(texts[i:j], kinds[i:j])])):
                    if lines:
                        np.add.at(total, Grams(lines).bucket, 1)
        by_slot = sums.reshape(2, -1, SLOT_SIZE)
        yield _rows({k: by_slot[:, k] for k in np.flatnonzero(by_slot.any(axis=(0, 2))).tolist()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + _unpacked(n.as_py())
        yield _rows(sums)

    schema = "slot int, n binary"
    rows = documents.where("text is not null").select("text", "nb_format").mapInArrow(count, schema).repartition("slot").mapInArrow(add, schema)
    out = np.zeros((2, BUCKETS // SLOT_SIZE, SLOT_SIZE))
    for k, n in rows.collect():  # a row per slot at most
        out[:, k] = _unpacked(bytes(n))
    return out[0].ravel(), out[1].ravel()


#: A line whose log-likelihood ratio is above this is no example of content.
MARGIN = 12


def fit(documents: DataFrame) -> Model:
    """Fit on all documents (text, nb_format), in two rounds."""
    own = counts(seeds()).astype(float)

    def ruled(docs: list[list[tuple[str, str]]]) -> tuple[list[str], list[str]]:
        both = [by_rule(us) for us in docs]
        return flat(x for x, _ in both), flat(x for _, x in both)

    filler, content = _counted(documents, ruled)
    weigh = lambda x: x * (own.sum() / max(x.sum(), own.sum()))  # noqa: E731  (no more weight than the seeds have)
    sent = documents.sparkSession.sparkContext.broadcast(Model(own, content))

    def again(docs: list[list[tuple[str, str]]]) -> tuple[list[str], list[str]]:
        """Lines of notebooks found to be residue, and lines that are content by rule but no examples of it."""
        ours = [by_rule(us)[1] for us in docs]
        lines = [x or body_of(us) for x, us in zip(ours, docs)]
        found, dropped, at = [], [], 0
        score = sent.value.score(flat(lines))
        for content, body in zip(ours, lines):
            x = score[at : at + len(body)]
            at += len(body)
            if content:
                dropped += [t for t, v in zip(content, x.tolist()) if v > MARGIN or not LEGIBLE.search(t)]
            elif (x > 0).all():
                found += body
        return found, dropped

    found, dropped = _counted(documents, again)
    sent.unpersist()
    return Model(own + weigh(filler) + weigh(found), content - dropped)


#: So many characters of a line without residue are content of its own.
OWN = 30
LEGIBLE = re.compile(r"\w")


def body_of(us: list[tuple[str, str]]) -> list[str]:
    """The lines that stand where content should: cell marks, headings and empty stubs do not; where nothing else is, prompts in stubs and slots in headings do."""
    body = [x for r, x in us if r in ("text", "code") and LEGIBLE.search(x)]
    return body or [x for r, x in us if (PROMPT.search(x) if r == "stub" else slotted(x))]


def judged(model: Model, texts: list[str | None], kinds: list[str | None]) -> list[tuple[float, bool]]:
    """(share of residue among what stands for content, whether nothing but residue stands there) of each text.

    All windows are scored. Null or blank text, and text of headings and stubs alone, has share 0 and is kept.
    """
    out = []
    for i, j in spans(texts):
        bodies = [body_of(units(t, k)) if t and t.strip() else [] for t, k in zip(texts[i:j], kinds[i:j])]
        bad, seen = model.windows(flat(bodies))
        of = np.repeat(np.arange(len(bodies)), [len(x) for x in bodies])
        total = lambda x: np.bincount(of, weights=x, minlength=len(bodies))  # noqa: B023, E731
        share = total(bad) / np.maximum(total(seen), 1)
        out += zip(share.tolist(), ((share >= COVERAGE) & (total(seen - bad >= OWN) == 0)).tolist())
    return out


def judge(model: Model, text: str | None, kind: str | None) -> tuple[float, bool]:
    return judged(model, [text], [kind])[0]


def residue_report(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, residue_share, exclude), one row per input row with an id."""
    model = model or fit(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(b: dict) -> dict:
        got = judged(sent.value, b["text"], b["nb_format"])
        return {"doc_id": b["doc_id"], "residue_share": [x for x, _ in got], "exclude": [x for _, x in got]}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "nb_format").where("doc_id is not null")
    return arrow_map(rows, run, "doc_id long, residue_share double, exclude boolean")


def residue_only(documents: DataFrame) -> DataFrame:
    """Distinct doc_id of the notebooks to exclude."""
    return residue_report(documents).where("exclude").select("doc_id").distinct()
