"""Tenant, user and namespace scopes: the only way to get at rows."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.errors import ValidationError


def identifier(value, field: str, limit: int = 1024) -> str:
    if not isinstance(value, str) or not value or value != value.strip() or len(value) > limit:
        raise ValidationError(field, f"{field} must be 1 to {limit} characters without surrounding space")
    return value


@dataclass(frozen=True)
class Scope:
    """user_id None stands for rows without a user, not for all users."""

    tenant_id: str
    namespace: str
    user_id: str | None = None

    def __post_init__(self):
        identifier(self.tenant_id, "tenantId")
        identifier(self.namespace, "namespace", 200)
        if self.user_id is not None:
            identifier(self.user_id, "userId")

    def read(self, df: DataFrame, active: bool = True, by_user: bool = True) -> DataFrame:
        """Rows of the scope; filters on partition columns prune files."""
        out = df.where((F.col("tenant_id") == self.tenant_id) & (F.col("namespace") == self.namespace))
        if by_user:
            out = out.where(F.col("user_id").eqNullSafe(F.lit(self.user_id)))
        return out.where("deleted_at is null") if active and "deleted_at" in df.columns else out

    def stamp(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"tenant_id": F.lit(self.tenant_id), "user_id": F.lit(self.user_id).cast("string"), "namespace": F.lit(self.namespace)})


def unscoped(df: DataFrame, allow: bool = False) -> DataFrame:
    """All rows, for maintenance; refused unless it is allowed by name."""
    if not allow:
        raise ValidationError("scope", "reading without a scope must be allowed explicitly")
    return df
