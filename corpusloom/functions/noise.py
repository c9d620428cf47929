"""Interface lines of encyclopaedia pages and presentation noise; always whole lines, never parts of prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole lines of the encyclopaedias' interface.
WIKI_LINES = (
    "adicionar tópico", "aparência ocultar", "barra lateral", "barra lateral ocultar", "criar conta", "discussão ler editar ver histórico", "doar criar conta iniciar sessão", "discussão contribuições", "editar", "editar código", "editar código fonte",
    "ferramentas aparência", "ferramentas aparência ocultar", "ferramentas mover", "ferramentas pessoais", "histórico ferramentas aparência ocultar", "ligações externas", "menu principal", "menu principal mover", "ocultar", "página foi editada",
    "predefinição predefinição predefinição", "principal mover",
)

# Patterns of whole interface lines, without regard to case.
WIKI_PATTERNS = (
    r"esta página foi editada pela última vez(?:\s+.*)?", r"página foi editada(?:\s+.*)?", r"editada pela última(?:\s+.*)?", r"(?:special\s+)?centralautologin(?:\s+.*)?", r"wiki\s+special\s+centralautologin(?:\s+.*)?",
    r"centralautologin(?:\s+(?:none|position|relative|absolute|fixed|static|\d+))*", r"(?:rlq\s+)?window\s+predefinição(?:\s+.*)?", r"(?:mw\.)?(?:loader|config)\.(?:load|implement|set)\s*\(.*", r"\.mw-parser-output(?:\s+.*)?", r"@media(?:\s+.*)?",
    r"body\.skin-(?:vector|minerva|timeless|monobook)(?:\s+.*)?",
)

# Words and phrases that are noise where they stand alone.
NOISE_WORDS = ("editar", "ferramentas", "ocultar", "predefinição")
NOISE_PHRASES = (
    "aparência ocultar", "barra lateral", "barra lateral ocultar", "centralautologin none", "centralautologin none position", "conta iniciar sessão", "criar conta", "discussão ler editar", "doar criar conta", "editar código", "editar código fonte",
    "editar ver histórico", "ferramentas aparência", "ferramentas aparência ocultar", "ferramentas mover", "ferramentas pessoais", "histórico ferramentas", "histórico ferramentas aparência", "lateral ocultar", "ler editar", "ocultar modo",
    "predefinição info", "predefinição predefinição", "predefinição predefinição predefinição", "rlq window predefinição", "special centralautologin", "special centralautologin none", "wiki special centralautologin", "window predefinição",
)


def canonical_line(line: Column) -> Column:
    """Lower case, with single blanks and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), "\\s+", " "))


def wiki_rule(line: Column) -> Column:
    """``literal:<line>`` or ``pattern:<number>`` of the first rule that a whole line matches; null if none does."""
    own = canonical_line(line)
    rule = F.when(own.isin(*WIKI_LINES), F.concat(F.lit("literal:"), own))
    for i, pattern in enumerate(WIKI_PATTERNS):
        rule = rule.when(own.rlike(f"^(?i:{pattern})$"), F.lit(f"pattern:{i}"))
    return rule


def is_noise(item: Column) -> Column:
    """Whether a term or phrase as a whole is presentation noise."""
    return canonical_line(item).isin(*sorted({*WIKI_LINES, *NOISE_WORDS, *NOISE_PHRASES}))
