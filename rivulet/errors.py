"""Errors with numeric codes, so callers can tell them apart without reading messages."""

from __future__ import annotations


class EngineError(Exception):
    code = 0

    def __init__(self, message: str):
        super().__init__(f"[{self.code}] {message}")


def _error(name: str, code: int, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "__doc__": doc, "__module__": __name__})


Malformed = _error("Malformed", 3000, "A predicate that can have no meaning, such as a negative radius.")
UnknownTable = _error("UnknownTable", 3001, "The table is not in the schema.")
UnknownColumn = _error("UnknownColumn", 3002, "The column is not in the table.")
Unsupported = _error("Unsupported", 3003, "A construct that the closed query surface leaves out.")
TypeMismatch = _error("TypeMismatch", 3004, "A literal that the column's type cannot hold.")
NoSpatialIndex = _error("NoSpatialIndex", 3010, "A spatial clause on a table without a spatial index.")
OutOfWindow = _error("OutOfWindow", 3020, "A point in time that is no longer retained.")
LimitRejected = _error("LimitRejected", 3030, "A limit above the maximum.")
ScanBudgetExceeded = _error("ScanBudgetExceeded", 3031, "More rows would be scanned than allowed.")
DeadlineExceeded = _error("DeadlineExceeded", 3032, "The query ran longer than allowed.")
UniqueViolation = _error("UniqueViolation", 3100, "Two rows share a key that is unique.")
CheckViolation = _error("CheckViolation", 3101, "A row fails a check.")
ForeignKeyViolation = _error("ForeignKeyViolation", 3102, "A row refers to no row, or is referred to.")
NotNullViolation = _error("NotNullViolation", 3103, "A null where none may be.")
SubscriptionLimit = _error("SubscriptionLimit", 6000, "More subscriptions than admitted.")
TableNotPublic = _error("TableNotPublic", 6001, "Only public tables can be subscribed.")
UnknownQueryId = _error("UnknownQueryId", 6002, "No such subscription.")
QueryRateLimited = _error("QueryRateLimited", 6003, "Too many queries of one caller.")
