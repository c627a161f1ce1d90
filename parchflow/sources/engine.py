"""The OCR engine on a machine, for the plug-in that calls it: where it is, what it can read, what else is installed."""

from __future__ import annotations

import importlib.util
import os
import platform
import shutil
import subprocess
from dataclasses import asdict, dataclass, field
from functools import cached_property

from parchflow.options import ReaderMissingError

# The environment variables of the engine, and its usual data folders.
COMMAND_VARIABLE, DATA_VARIABLE = "TESSERACT_CMD", "TESSDATA_PREFIX"
DATA_FOLDERS = ("/usr/share/tesseract-ocr/5/tessdata", "/usr/share/tessdata", "/usr/local/share/tessdata", "/opt/homebrew/share/tessdata")
ADVICE = f"install the engine's system package, or name its binary in {COMMAND_VARIABLE}"


def version_in(report: str) -> str | None:
    """The version of the first line of a version report: what follows the engine's name, else the line."""
    line = next((x.strip() for x in report.splitlines() if x.strip()), "")
    words = line.split()
    return (words[1].removeprefix("v") if len(words) > 1 and words[0].lower() == "tesseract" else line) or None


def languages_in(report: str) -> list[str]:
    """The languages of a listing: its lines of one plain word, sorted, each once."""
    words = {x.strip() for x in report.splitlines()}
    return sorted(w for w in words if w and w.replace("_", "").replace("-", "").isalnum() and w.isascii())


@dataclass
class Engine:
    """One installation: `command` is a path or a name to look for; probes run once and end after `patience` seconds."""

    command: str | None = None
    patience: float = 5.0
    environment: dict[str, str] = field(default_factory=lambda: dict(os.environ))

    @cached_property
    def binary(self) -> str | None:
        """A command given is the only one looked for; else the variable's, else the engine's own name on the path."""
        wanted = [self.command] if self.command else [self.environment.get(COMMAND_VARIABLE), "tesseract"]
        found = (shutil.which(os.path.expandvars(os.path.expanduser(w.strip())), path=self.environment.get("PATH")) for w in wanted if w and w.strip())
        return next((f for f in found if f), None)

    def ask(self, flag: str) -> str:
        """What the binary prints for a flag; nothing if it can't be run or takes too long."""
        if self.binary is None:
            return ""
        try:
            done = subprocess.run([self.binary, flag], stdout=subprocess.PIPE, stderr=subprocess.STDOUT, timeout=self.patience, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return ""
        return done.stdout.decode("utf-8", "replace")

    @cached_property
    def version(self) -> str | None:
        return version_in(self.ask("--version"))

    @cached_property
    def languages(self) -> list[str]:
        return languages_in(self.ask("--list-langs")) if self.version else []

    @cached_property
    def data_folder(self) -> str | None:
        beside = [os.path.join(os.path.dirname(self.binary), "tessdata")] if self.binary else []
        own = [self.environment[DATA_VARIABLE]] if self.environment.get(DATA_VARIABLE) else []
        return next(filter(os.path.isdir, own + beside + list(DATA_FOLDERS)), None)

    def lacks(self, required: list[str]) -> list[str]:
        have = {x.lower() for x in self.languages}
        return [x for x in dict.fromkeys(required) if x.strip().lower() not in have]

    def fault(self, required: list[str] = ()) -> str | None:
        """Why it can't be used for some languages, None if it can."""
        if self.binary is None:
            return "no binary found"
        if self.version is None:
            return f"{self.binary} does not tell its version"
        return f"languages missing: {', '.join(gone)}" if (gone := self.lacks(list(required))) else None


@dataclass(frozen=True)
class Diagnostics:
    """A row of the table of engines."""

    is_available: bool
    binary_path: str | None
    version: str | None
    available_languages: tuple[str, ...]
    tessdata_path: str | None
    error_message: str | None
    instructions: str | None


def diagnose(command: str | None = None) -> Diagnostics:
    e = Engine(command)
    fault = e.fault()
    return Diagnostics(fault is None, e.binary, e.version, tuple(e.languages), e.data_folder if fault is None else None, fault, ADVICE if fault else None)


def require(languages: list[str], command: str | None = None) -> Engine:
    e = Engine(command)
    if fault := e.fault(languages):
        raise ReaderMissingError(f"{fault}; {ADVICE}")
    return e


def info() -> dict:
    """What runs here: Python, Spark, optional libraries, the engine."""
    import pyspark

    from parchflow import __version__

    libraries = {n: importlib.util.find_spec(n) is not None for n in ("pymupdf", "pytesseract", "PIL")}
    d = diagnose()
    return {"package": __version__, "python": platform.python_version(), "spark": pyspark.__version__, "libraries": libraries, "engine": asdict(d), "status": {"native": libraries["pymupdf"], "ocr": d.is_available and libraries["pytesseract"]}}
