"""Errors that callers can catch by layer."""


class FathomError(Exception):
    """Base of all errors raised here."""


class DataError(FathomError):
    """Input could not be read or is not what it should be."""


class InvalidDateRange(DataError):
    """The start of a range is after its end."""


class MissingData(DataError):
    """A scan found no rows for what was asked."""


class ParseError(DataError):
    """A payload could not be parsed."""


class CovarianceError(FathomError):
    """A covariance estimate is not possible."""


class InsufficientData(CovarianceError):
    """Fewer observations than the estimator needs."""

    def __init__(self, needed: int, have: int) -> None:
        super().__init__(f"needs {needed} observations, has {have}")
        self.needed, self.have = needed, have


class InvalidParameter(FathomError, ValueError):
    """A configuration value is out of its range."""


class DimensionMismatch(CovarianceError):
    """Factors or weights do not fit together."""


class SpecificRiskError(FathomError):
    """A specific risk estimate is not possible."""


class RiskModelError(FathomError):
    """The risk model is not fitted or its inputs do not fit."""


class ExportError(FathomError):
    """An export could not be written."""


class ReportError(FathomError):
    """A report could not be built."""


class PipelineError(FathomError):
    """A step of the analysis found nothing to work on."""
