"""The catalogue of panel fields, and the order in which derived ones are built."""

from __future__ import annotations

from dataclasses import dataclass

RAW = {
    "date": "day of the bar",
    "ticker": "name of the security",
    "open": "first price, as traded",
    "high": "top price of the bar, as traded",
    "low": "bottom price of the bar, as traded",
    "close": "last price, as traded",
    "volume": "number of shares that changed hands",
    "dividends": "cash paid for a share, on the bar from which a buyer no longer gets it",
    "splits": "new shares for an old one, on the bar from which they trade; 0 on all other bars",
    "sector": "broad line of business",
    "industry": "narrow line of business",
    "shares_outstanding": "number of shares there are, by the latest report",
}
DERIVED = {
    "returns": ("change of the close to the one before, with dividends, and as if no split had been", ("close", "dividends", "splits")),
    "typical_price": ("mean of the prices at top, bottom and end of the bar, for want of a volume-weighted one", ("high", "low", "close")),
    "dollar_volume": ("close times volume: money that changed hands", ("close", "volume")),
    "market_cap": ("close times the latest number of shares", ("close", "shares_outstanding")),
    "adv20": ("mean of dollar_volume over up to 20 bars", ("dollar_volume",)),
    "volatility20": ("sample deviation of returns over 20 bars", ("returns",)),
}
STATIC = ("sector", "industry", "shares_outstanding")
KEYS = ("date", "ticker")


@dataclass(frozen=True)
class FieldInfo:
    name: str
    description: str
    depends_on: tuple[str, ...] = ()

    @property
    def derived(self) -> bool:
        return bool(self.depends_on)


FIELDS = {n: FieldInfo(n, d) for n, d in RAW.items()} | {n: FieldInfo(n, d, deps) for n, (d, deps) in DERIVED.items()}


def field_info(name: str) -> FieldInfo:
    if name not in FIELDS:
        raise KeyError(f"{name!r} is not a known field")
    return FIELDS[name]


def derived_fields() -> list[str]:
    return list(DERIVED)


def with_dependencies(names: list[str]) -> list[str]:
    """names and all that they are derived from, derived fields in building order after the raw ones."""
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += field_info(name).depends_on
    return [n for n in FIELDS if n in wanted]
