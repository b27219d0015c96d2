"""What content may be stored, and what is said about content that isn't."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import basename, glob_match

#: The default ceiling of stored content, in bytes.
MAX_CONTENT_BYTES = 104_857_600
#: Paths whose content is withheld unless settings say otherwise.
DENY_GLOBS = (".env*", "*.pem", "id_rsa*", "*/.ssh/*", "*credentials*")


@dataclass(frozen=True)
class Policy:
    """Deny globs, tried on the full path and its last part, and a ceiling of size."""

    deny: tuple[str, ...] = DENY_GLOBS
    max_bytes: int = MAX_CONTENT_BYTES

    def denies(self, path: Column) -> Column:
        return glob_match(path, list(self.deny)) | glob_match(basename(path), list(self.deny))

    def decide(self, path: Column, size: Column) -> Column:
        """Denied before TooLarge before Store; null for content of unknown size that isn't denied."""
        return F.when(self.denies(path), "Denied").when(size > self.max_bytes, "TooLarge").when(size.isNotNull(), "Store")


def content_state(content: Column, mode: Column, disposition: Column) -> Column:
    """deleted, unknown, stored or withheld: three ways of not having content stay apart."""
    return F.when(mode == "Deleted", "deleted").when(content.isNull(), "unknown").when(disposition == "Store", "stored").otherwise("withheld")


def content_key(path: Column, cid: Column, state: Column) -> Column:
    """The identity of a file version's content: the true id, or a descriptor that names the path."""
    return F.when(state == "deleted", F.concat(F.lit("deleted:"), path)).when(state == "unknown", F.concat(F.lit("unknown:"), path)).otherwise(cid)


@dataclass
class Config:
    """Component settings, with everything that is wrong with them."""

    deny: tuple[str, ...] = DENY_GLOBS
    max_bytes: int = MAX_CONTENT_BYTES
    manifest_dir: str = "manifests"
    providers: tuple[dict, ...] = ()
    problems: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: dict) -> Config:
        """Read settings; a field that is refused keeps its default and leaves a problem. Unknown keys are ignored, but not in a provider."""
        c = cls()
        if "manifest_dir" in raw:
            if isinstance(raw["manifest_dir"], str) and raw["manifest_dir"]:
                c.manifest_dir = raw["manifest_dir"]
            else:
                c.problems.append("error: manifest_dir must be a non-empty string")
        if "deny_globs" in raw:
            globs = raw["deny_globs"]
            if isinstance(globs, list) and all(isinstance(g, str) for g in globs):
                c.deny = tuple(globs)
                if not globs:
                    c.problems.append("warning: deny_globs is empty")
            else:
                c.problems.append("error: deny_globs must be a list of strings")
        if "max_content_bytes" in raw:
            size = raw["max_content_bytes"]
            if isinstance(size, int) and not isinstance(size, bool) and size > 0:
                c.max_bytes = size
            else:
                c.problems.append("error: max_content_bytes must be a positive integer")
        for block in raw.get("provider_manifests") or []:
            models = block.get("models") if isinstance(block, dict) else None
            if not (isinstance(models, list) and models and all(isinstance(m, str) and m for m in models)) or set(block) - {"base_url", "api_key_env", "models"} or not str(block.get("base_url", "")).startswith("https://"):
                c.problems.append(f"error: provider block {block!r} is refused")
            else:
                c.providers += (block,)
        return c

    @property
    def policy(self) -> Policy:
        return Policy(self.deny, self.max_bytes)
