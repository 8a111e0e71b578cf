"""Settings that are part of the semantics, passed explicitly; there are no globals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    schema_version: str = "1.1.0"
    max_lines: int = 50
    overlap: int = 10
    max_query_chars: int = 2000
    max_file_bytes: int = 5 * 1024 * 1024
    max_context_chars: int = 120_000
    candidates: int = 30
    k: int = 4
    max_enriched_files: int = 15
    max_enriched_chars: int = 3000
    compress: bool = True
    min_score: float = -2.0
    rrf_constant: int = 60
    dimensions: int = 768
    embedding_model: str = "mock"
    # fixed values: folders that a scan leaves out (with our own index), and the extensions it takes (case-sensitive)
    ignored_dirs: tuple[str, ...] = (
        "node_modules", "dist", ".git", ".angular", ".next", "build", ".sedimark",
        ".agents", "scripts-test", "specs", "generated", ".vercel", ".turbo", "out", "coverage",
    )
    extensions: tuple[str, ...] = (".ts", ".js", ".tsx", ".jsx", ".html", ".prisma", ".py", ".css")


DEFAULTS = Settings()
