"""Options of the operators, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .errors import InvalidDegree, InvalidIterations, InvalidJump, InvalidOrder, InvalidPeriod, InvalidSmoothing, InvalidSpan, InvalidWindow, OptionError

PERIODIC = "periodic"


def check_choice(name: str, value: str, choices: tuple[str, ...]) -> None:
    if value not in choices:
        raise OptionError(f"{name} is {value!r}; it can be {', '.join(choices)}")


@dataclass(frozen=True)
class LoessOptions:
    span: float
    degree: int = 1

    def __post_init__(self):
        if not (isinstance(self.span, (int, float)) and 0 < self.span <= 1):
            raise InvalidSpan(f"span {self.span} is not in (0, 1]")
        if self.degree not in (0, 1, 2):
            raise InvalidDegree(f"degree {self.degree} is not 0, 1 or 2")


@dataclass(frozen=True)
class DecomposeOptions:
    period: int
    mode: str = "additive"
    missing: str = "error"

    def __post_init__(self):
        if self.period < 2:
            raise InvalidPeriod(f"period {self.period} is under 2")
        check_choice("mode", self.mode, ("additive", "multiplicative"))
        check_choice("missing", self.missing, ("error", "interpolate"))


def odd_at_least(x: float) -> int:
    n = math.ceil(x)
    return max(n + 1 - n % 2, 1)


@dataclass(frozen=True)
class StlOptions:
    """``seasonal`` is an odd window of 7 or more, or "periodic"."""

    period: int
    seasonal: int | str = 7
    trend: int | None = None
    inner: int = 2
    outer: int = 0
    mode: str = "additive"
    seasonal_jump: int = 1
    trend_jump: int = 1
    low_pass_jump: int = 1
    missing: str = "error"

    def __post_init__(self):
        if self.period < 2:
            raise InvalidPeriod(f"period {self.period} is under 2")
        if self.seasonal != PERIODIC and (not isinstance(self.seasonal, int) or self.seasonal < 7 or self.seasonal % 2 == 0):
            raise InvalidWindow(f"the seasonal window {self.seasonal} is not an odd number from 7 on")
        if self.trend is not None and (self.trend < 3 or self.trend % 2 == 0):
            raise InvalidWindow(f"the trend window {self.trend} is not an odd number from 3 on")
        if self.inner < 1 or self.outer < 0:
            raise InvalidIterations("inner is at least 1, outer at least 0")
        for name in ("seasonal_jump", "trend_jump", "low_pass_jump"):
            if getattr(self, name) < 1:
                raise InvalidJump(f"{name} is under 1")
        check_choice("mode", self.mode, ("additive", "multiplicative"))
        check_choice("missing", self.missing, ("error", "interpolate"))

    @property
    def low_pass_window(self) -> int:
        return odd_at_least(self.period)

    @property
    def trend_window(self) -> int:
        if self.trend is not None:
            return self.trend
        shrink = 1.0 if self.seasonal == PERIODIC else 1 - 1.5 / self.seasonal
        return odd_at_least(1.5 * self.period / shrink)


@dataclass(frozen=True)
class HoltWintersOptions:
    """beta 0: no trend; gamma 0 or a period under 2: no season."""

    alpha: float
    beta: float = 0.0
    gamma: float = 0.0
    period: int = 0
    mode: str = "additive"

    def __post_init__(self):
        for name in ("alpha", "beta", "gamma"):
            if not 0 <= getattr(self, name) <= 1:
                raise InvalidSmoothing(f"{name} {getattr(self, name)} is not in [0, 1]")
        check_choice("mode", self.mode, ("additive", "multiplicative"))

    @property
    def has_trend(self) -> bool:
        return self.beta > 0

    @property
    def has_season(self) -> bool:
        return self.gamma > 0 and self.period >= 2


@dataclass(frozen=True)
class ArimaOptions:
    """Orders (p, d, q), seasonal orders (P, D, Q) of period m; constant and method."""

    order: tuple[int, int, int]
    seasonal: tuple[int, int, int] = (0, 0, 0)
    period: int = 0
    constant: bool = True
    method: str = "css"

    def __post_init__(self):
        (p, d, q), (sp, sd, sq) = self.order, self.seasonal
        if min(p, d, q, sp, sd, sq) < 0 or max(p, q) > 10 or d > 2:
            raise InvalidOrder(f"order {self.order} {self.seasonal}: p, q up to 10 and d up to 2")
        if sp + sd + sq and self.period < 2:
            raise InvalidOrder("seasonal orders need a period from 2 on")
        check_choice("method", self.method, ("css", "mle", "css-mle"))

    @property
    def ar_reach(self) -> int:
        return self.order[0] + self.seasonal[0] * self.period

    @property
    def ma_reach(self) -> int:
        return self.order[2] + self.seasonal[2] * self.period

    @property
    def lost(self) -> int:
        return self.order[1] + self.seasonal[1] * self.period

    @property
    def least(self) -> int:
        return self.lost + max(self.ar_reach, self.ma_reach) + 2


@dataclass(frozen=True)
class AutoArimaOptions:
    """Limits of the order search. ``constant`` None: the search tries both."""

    period: int = 0
    max_p: int = 5
    max_q: int = 5
    max_d: int = 2
    max_seasonal_p: int = 2
    max_seasonal_q: int = 2
    max_seasonal_d: int = 1
    max_rounds: int = 50
    method: str = "css"
    constant: bool | None = None

    def __post_init__(self):
        check_choice("method", self.method, ("css", "mle", "css-mle"))
        if self.period < 0:
            raise InvalidPeriod(f"period {self.period} is under 0")
