"""Errors. Option errors are raised where an operator is called; errors of the data are
raised when a series is computed, or reported in a column with ``on_error="null"``."""


class SeriesError(ValueError):
    """Base of all errors of this package."""


class OptionError(SeriesError):
    """An option is out of its range."""


class DataError(SeriesError):
    """A series does not meet an operator's needs."""


class EmptySeries(DataError):
    pass


class NonFinite(DataError):
    pass


class SeriesTooShort(DataError):
    def __init__(self, n: int, least: int):
        super().__init__(f"series has {n} values, at least {least} are needed")
        self.n, self.least = n, least


class NonPositive(DataError):
    pass


class NonInvertible(DataError):
    pass


class TooFewObservations(DataError):
    pass


class ExogMismatch(DataError):
    pass


class SingularModel(DataError):
    pass


class NotConverged(DataError):
    pass


class InvalidPeriod(OptionError):
    pass


class InvalidSpan(OptionError):
    pass


class InvalidDegree(OptionError):
    pass


class InvalidWindow(OptionError):
    pass


class InvalidJump(OptionError):
    pass


class InvalidIterations(OptionError):
    pass


class InvalidSmoothing(OptionError):
    pass


class InvalidOrder(OptionError):
    pass


class InvalidLags(OptionError):
    pass


class WrongType(OptionError):
    pass
