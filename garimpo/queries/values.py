"""Values that the SQL of the text queries expects. They are written down here on their own, so that a slip in the operators' values shows."""

from __future__ import annotations

# Words that are no tokens.
STOP_WORDS = (
    "a ao aos as ate com como da das de del dem des do dos e eh ela elas ele eles em entre era essa essas esse esses esta estas este estes eu foi for foram "
    "ha isso isto ja la lhe lhes lo los mais mas me meu meus minha minhas muito na nao nas nem no nos nossa nossas nosso nossos num numa o os ou para pela "
    "pelas pelo pelos por qual quais quando que quem sao se sem ser sera seu seus sim so sob sobre sua suas tal tambem te tem ter toda todas todo todos tu "
    "tua tuas tudo um uma umas uns vai vao voce voces"
).split()

# Personal data and their labels, in this order.
PII = (
    (r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}", "[CPF]"),
    (r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}", "[CNPJ]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"\(?\d{2}\)?\s?\d{4,5}-?\d{4}", "[TELEFONE]"),
)

# Texts that try to steer a model, in plain lower case.
INJECTION = (
    r"ignor[ea]\s+(as\s+)?instrucoes",
    r"ignore\s+(previous|above|all)\s+(instructions|prompts|rules)",
    r"disregard\s+(previous|above|all)",
    r"forget\s+(your|all|previous)\s+(instructions|rules|prompts)",
    r"you\s+are\s+now\s+a",
    r"agora\s+voce\s+e\s+um",
    r"novo\s+papel|new\s+role|act\s+as",
    r"system\s*:\s*",
    r"<\s*/?\s*system\s*>",
    r"\[inst\]|\[/inst\]|<\|im_start\|>",
    r"repita\s+o\s+prompt|repeat\s+the\s+(system\s+)?prompt",
    r"mostre\s+(seu|o)\s+prompt|show\s+(your|the)\s+prompt",
    r"qual\s+e\s+o\s+seu\s+prompt",
)

# What is taken out of a context, and what stands for it.
CONTEXT_MARKS = (
    r"(?i)ignor[ea]\s+(as\s+)?instru[çc][õo]es[^.]*",
    r"(?i)ignore\s+(previous|above|all)\s+instructions[^.]*",
    r"(?i)system\s*:\s*[^\n]*",
    r"(?is)<\s*system\s*>.*?<\s*/\s*system\s*>",
    r"(?is)\[INST\].*?\[/INST\]",
)
REMOVED = "[conteúdo removido]"

# Headers, footers and watermarks of pages.
PAGE_MARKS = (
    r"^[^\n]{0,200}(?:Nº/Rev\.:|N°/Rev\.:)[^\n]*Este documento faz parte[^\n]*\n?",
    r"\(Baixado por [^\n)]+\)\s*",
    r"P[áa]gina\s+\d+\s+de\s+\d+\s*",
    r"Classifica[çc][ãa]o da Informa[çc][ãa]o:\s*\w+\s*",
    r"<!--\s*image\s*-->\s*",
)

# Letters with marks and the plain ones.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
BARE = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"

# Units of structure that texts refer to.
STRUCTURES = ("titulo", "capitulo", "secao", "subsecao", "artigo")
