"""Typed detectors: which fields they concern, what texts they accept, what they extract."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelattice.functions.text import strip

# Patterns and keyword lists of the detectors, in their order.
MONTHS = "jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez|january|february|march|april|may|june|july|august|september|october|november|december"
DATE = rf"\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{MONTHS})[a-z]*\s+\d{{2,4}}"
MONEY = r"(?i)(?:R\s*\$|US\s*\$|\$|€|£|BRL|USD|EUR|GBP)\s*(?:\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?|\d+[.,]\d{2}|\d+)"
CPF_CNPJ = r"(?:\d{3}[.-]?\d{3}[.-]?\d{3}[.-]?\d{2})|(?:\d{2}[.-]?\d{3}[.-]?\d{3}[/-]?\d{4}[.-]?\d{2})|(?:^\d{11}$)|(?:^\d{14}$)"
PHONE = r"(?:\(?\d{2}\)?\s?)?\d{4,5}[.-]?\d{4}|(?:\+?\d{1,3}[\s.-]?)?\(?\d{2,3}\)?[\s.-]?\d{4,5}[\s.-]?\d{4}|(?:^\d{10,11}$)"
ADDRESS = r"(?i)(?:rua|av|avenida|rod|rodovia|estrada|travessa|praça|alameda|via)[\s.]*[^\s,]+|\d{5}[-.]?\d{3}|(?:cep|zip|postal)[\s:]*\d{5}[-.]?\d{3}"
POSTAL = r"\b\d{5}[-.]?\d{3}\b"
POSTAL_WORD = r"\b(?:cep|zip|postal)\b"
STREETS = "rua av avenida rod rodovia estrada travessa praça alameda via boulevard blvd avenue street"
#: A word that begins with a street word.
STREET = rf"(?:^|\s)(?:{STREETS.replace(' ', '|')})"
LETTER = "[A-Za-zÀ-ÿ]"
ACRONYMS = "PR SP RJ MG RS BA SC GO PE CE DF ES MT MS PA PB AM RN AL PI TO MA SE RO AC AP RR BR US EUA CNPJ CPF RG IE UF OAB CRC CREA"
DATE_WORDS = (
    "data date vencimento venc expira expiration emissao emissão emission inicio início start fim end final termino término "
    "termination periodo período period prazo deadline aniversario aniversário birthday nascimento"
)
MONEY_WORDS = (
    "valor value preco preço price custo cost total subtotal desconto discount taxa fee pagamento payment pago paid parcela "
    "installment saldo balance montante amount dinheiro money receita revenue despesa expense lucro profit prejuizo prejuízo loss cifra cifrão"
)
PHONE_WORDS = "telefone phone fone celular mobile cel whatsapp whats contato contact tel ddd"
ADDRESS_WORDS = (
    "endereco endereço address rua street avenida avenue bairro neighborhood cidade city estado state uf cep zip postal code "
    "local location logradouro numero número number complemento complement"
)
NAME_TAIL = r"[^\wÀ-ÿ\s-]+$"
NAME_WORDS = "nome name pessoa person profissional cliente"
NAME_PHRASES = ("nome completo", "nome da pessoa", "nome do profissional")
ID_WORDS = ("documento", "identificacao", "identificação", "inscricao", "inscrição")


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def _has_word(words: str) -> Callable[[str, str], bool]:
    return lambda name, description: any(w in f"{name} {description}".lower() for w in words.split())


def _concerns_id(name: str, description: str) -> bool:
    text = f"{name} {description}".lower()
    return "cpf" in text or "cnpj" in text or (any(w in text for w in ID_WORDS) and "identidade" not in text and "rg" not in text)


def _concerns_name(name: str, description: str) -> bool:
    return any(w in name.lower() for w in NAME_WORDS.split()) or any(p in description.lower() for p in NAME_PHRASES)


def _ratio(c: Column) -> Column:
    return _digits(c) / F.greatest(F.length(c), F.lit(1))


def _address(c: Column) -> Column:
    mixed = strip(c).rlike(r"\s") & c.rlike(r"\d") & c.rlike(LETTER)
    return F.lower(c).rlike(f"{STREET}|{POSTAL_WORD}|{POSTAL}") | mixed


def _name(c: Column) -> Column:
    t = strip(c)
    long = F.when(t.rlike(r"\s"), t.rlike(r"\S{3}")).otherwise(F.length(t) >= 4)
    return (F.length(t) >= 3) & ~F.upper(t).isin(ACRONYMS.split()) & (_ratio(t) <= 0.3) & long & t.rlike(LETTER)


def _bare_name(c: Column) -> Column:
    """The text without marks at its end, if it is still a name."""
    t = strip(F.regexp_replace(strip(c), NAME_TAIL, ""))
    return F.when(_name(t), t)


@dataclass(frozen=True)
class Hint:
    """One detector; priority 1 is the most specific."""

    name: str
    priority: int
    concerns: Callable[[str, str], bool]
    detect: Callable[[Column], Column]
    extract: Callable[[Column], Column]
    aggregate: str = "first"


def _first(pattern: str) -> Callable[[Column], Column]:
    return lambda c: F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


HINTS = (
    Hint("date", 1, _has_word(DATE_WORDS), lambda c: c.rlike(DATE), _first(DATE)),
    Hint("money", 1, _has_word(MONEY_WORDS), lambda c: c.rlike(MONEY), _first(MONEY), "sum"),
    Hint("cpf_cnpj", 1, _concerns_id, lambda c: _digits(c).isin(11, 14) & c.rlike(CPF_CNPJ), _first(CPF_CNPJ)),
    Hint("phone", 1, _has_word(PHONE_WORDS), lambda c: _digits(c).between(10, 15) & c.rlike(PHONE), _first(PHONE)),
    Hint("address", 1, _has_word(ADDRESS_WORDS), _address, _first(ADDRESS), "list"),
    Hint("name", 2, _concerns_name, _name, _bare_name, "concatenate"),
    Hint("text", 3, lambda n, d: True, lambda c: c.rlike(LETTER) & (_ratio(c) <= 0.8), strip),
)
BY_NAME = {h.name: h for h in HINTS}


class Registry:
    """Detectors by name; a later one of a name takes its place."""

    def __init__(self, hints=HINTS):
        self.hints = list(hints)

    def register(self, hint: Hint) -> None:
        same = [i for i, h in enumerate(self.hints) if h.name == hint.name]
        if same:
            self.hints[same[0]] = replace(hint)
        else:
            self.hints.append(hint)

    def ordered(self) -> list[Hint]:
        """By priority, in the order they were registered."""
        return sorted(self.hints, key=lambda h: h.priority)

    def relevant(self, name: str, description: str) -> list[Hint]:
        return sorted((h for h in self.hints if h.concerns(name, description)), key=lambda h: h.priority)

    def specific(self, name: str, description: str) -> list[Hint]:
        last = max((h.priority for h in self.hints), default=0)
        return [h for h in self.relevant(name, description) if h.priority < last]


def amount(c: Column) -> Column:
    """Number of a money text, comma as the decimal point; null if it is none."""
    return F.regexp_replace(F.regexp_replace(c, r"R\s*\$|\s", ""), ",", ".").try_cast("double")


def aggregated(values: Column, strategy: str) -> Column:
    """An aggregate over several values of a field: first, concatenate, list or sum."""
    if strategy == "concatenate":
        return F.concat_ws(" ", F.collect_list(values))
    if strategy == "list":
        return F.concat_ws(", ", F.collect_list(values))
    if strategy == "sum":
        whole = F.count(values) == F.count(amount(values))
        return F.when(whole, F.sum(amount(values)).cast("string")).otherwise(F.concat_ws(" + ", F.collect_list(values)))
    return F.first(values, ignorenulls=True)
