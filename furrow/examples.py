"""Small schemas for queries, benches and tests."""

from __future__ import annotations

from .schema import Column, DataType, ForeignKey, Schema, Table, parse_check


def _table(name: str, *columns: tuple, key: tuple[str, ...] = ("id",), uniques: list[tuple[str, ...]] = (), checks: list[str] = (), keys: list[tuple] = ()) -> Table:
    """Columns are (name, type, nullable, options)."""
    t = Table(name)
    for c in columns:
        options = dict(c[3]) if len(c) > 3 else {}
        t.add(Column(c[0], DataType("enum", name="enum") if "enum_values" in options else DataType.parse(c[1]), c[2] if len(c) > 2 else True, **options))
    t.primary_key, t.uniques, t.checks = key, list(uniques), [parse_check(x) for x in checks]
    t.foreign_keys = [ForeignKey(tuple(c), p, tuple(pc)) for c, p, pc in keys]
    return t


_ID = ("id", "integer", False, {"auto_increment": True, "has_default": True})


def shop() -> Schema:
    """Users, categories (with parents), products, orders, items and stores."""
    s = Schema(name="shop", enums={"order_status": ["pending", "processing", "shipped", "delivered", "cancelled"]})
    s.add(_table("users", _ID, ("email", "varchar", False, {"max_length": 255}), ("first_name", "varchar"), ("last_name", "varchar"), ("password_hash", "varchar"), ("is_active", "boolean", False), ("created_at", "timestamp", False), ("updated_at", "timestamp"), ("deleted_at", "timestamp"), uniques=[("email",)]))
    s.add(_table("categories", _ID, ("name", "varchar", False), ("slug", "varchar", True), ("parent_id", "integer"), ("description", "text"), uniques=[("slug",)], keys=[(["parent_id"], "categories", ["id"])]))
    s.add(_table("products", _ID, ("name", "varchar", False), ("price", "numeric", False, {"precision": 10, "scale": 2}), ("category_id", "integer"), ("sku", "varchar", False), ("weight", "double", False), ("color", "varchar", False), uniques=[("sku",)], checks=["(price >= 0)"], keys=[(["category_id"], "categories", ["id"])]))
    s.add(_table("orders", _ID, ("user_id", "integer", False), ("status", "", False, {"enum_values": s.enums["order_status"]}), ("total", "double", False), ("order_number", "varchar", False), ("notes", "text"), ("created_at", "timestamp", False), uniques=[("order_number",)], checks=["(total >= 0)"], keys=[(["user_id"], "users", ["id"])]))
    s.add(_table("order_items", _ID, ("order_id", "integer", False), ("product_id", "integer", False), ("quantity", "integer", False), ("unit_price", "double", False), uniques=[("order_id", "product_id")], checks=["(quantity > 0)", "(unit_price >= 0)"], keys=[(["order_id"], "orders", ["id"]), (["product_id"], "products", ["id"])]))
    s.add(_table("stores", _ID, ("street_address", "varchar", False), ("city", "varchar", False), ("state", "varchar", False), ("zip_code", "varchar", False), ("country", "varchar", False), ("latitude", "double", False), ("longitude", "double", False), ("start_date", "date", False), ("end_date", "date", False)))
    return s


def circular() -> Schema:
    """Employees and departments that refer to each other, and employees to themselves."""
    s = Schema(name="circular")
    s.add(_table("employees", _ID, ("name", "varchar", False), ("email", "varchar"), ("department_id", "integer"), ("manager_id", "integer"), uniques=[("email",)], keys=[(["department_id"], "departments", ["id"]), (["manager_id"], "employees", ["id"])]))
    s.add(_table("departments", _ID, ("name", "varchar", False), ("head_id", "integer"), ("budget", "numeric", True, {"precision": 12, "scale": 2}), checks=["(budget >= 0)"], keys=[(["head_id"], "employees", ["id"])]))
    return s


def blog() -> Schema:
    """UUID keys, composite keys and columns whose meanings don't fit their types."""
    s = Schema(name="blog")
    s.add(_table("tags", _ID, ("name", "varchar", False), ("color", "varchar"), uniques=[("name",)]))
    s.add(_table("posts", ("id", "uuid", False), ("title", "varchar", False), ("slug", "varchar"), ("body", "text"), ("author_email", "varchar"), ("status", "varchar"), ("view_count", "integer"), ("metadata", "jsonb"), ("published_at", "timestamptz"), ("created_at", "timestamptz"), uniques=[("slug",)], checks=["(view_count >= 0)"]))
    s.add(_table("post_tags", ("post_id", "uuid", False), ("tag_id", "integer", False), key=("post_id", "tag_id"), keys=[(["post_id"], "posts", ["id"]), (["tag_id"], "tags", ["id"])]))
    s.add(_table("comments", _ID, ("post_id", "uuid", False), ("parent_id", "integer"), ("author_name", "varchar"), ("body", "text", False), ("created_at", "timestamptz"), keys=[(["post_id"], "posts", ["id"]), (["parent_id"], "comments", ["id"])]))
    return s
