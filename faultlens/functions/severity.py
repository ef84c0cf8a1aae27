"""Severity of an error type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types of each severity above low.
CRITICAL = ["SecurityError", "NoMemoryError", "SystemStackError", "SignalException", "ActiveRecord::StatementInvalid", "LoadError", "SyntaxError", "ActiveRecord::ConnectionNotEstablished", "Redis::ConnectionError", "OpenSSL::SSL::SSLError"]
HIGH = ["ActiveRecord::RecordNotFound", "ArgumentError", "TypeError", "NoMethodError", "NameError", "ZeroDivisionError", "FloatDomainError", "IndexError", "KeyError", "RangeError"]
MEDIUM = ["ActiveRecord::RecordInvalid", "Timeout::Error", "Net::ReadTimeout", "Net::OpenTimeout", "ActiveRecord::RecordNotUnique", "JSON::ParserError", "CSV::MalformedCSVError", "Errno::ECONNREFUSED"]
LEVELS = {"critical": CRITICAL, "high": HIGH, "medium": MEDIUM}


def severity(error_type: Column, custom: dict[str, str] | None = None) -> Column:
    """Custom rules first, then the fixed lists, else low."""
    out = F.when(F.lit(False), "low")
    for name, level in (custom or {}).items():
        out = out.when(error_type == name, level)
    for level, names in LEVELS.items():
        out = out.when(error_type.isin(names), level)
    return out.otherwise("low")


def severity_is(error_type: Column, level: str) -> Column:
    """The list filter of one severity; custom rules play no part in it. Low is all that no list names."""
    if level in LEVELS:
        return error_type.isin(LEVELS[level])
    return ~error_type.isin([t for names in LEVELS.values() for t in names])
