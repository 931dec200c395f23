"""Text fragments shared by oracles (title case, category clean-up)."""


def title_case(s: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({s}, '\\p{{L}}+|\\P{{L}}+'), "
            f"lambda x: upper(x[1]) || lower(x[2:])), '')")


def clean_category(s: str, fallback: str = "Uncategorised") -> str:
    tail = f"trim(regexp_replace({s}, '^[^-]*-', ''))"
    return (f"(CASE WHEN {s} IS NULL OR lower(trim({s})) IN ('', 'nan', 'none') OR {tail} = '' "
            f"THEN '{fallback}' ELSE {title_case(tail)} END)")
