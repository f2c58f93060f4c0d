"""The whole run: files -> filter -> scan -> mask -> compress -> render, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import compress, files, render, scan

PRESETS = {"lean": {"compress": True, "level": "aggressive", "mask": True}, "medium": {"compress": True, "level": "medium", "mask": True}, "full": {"compress": False, "level": "low", "mask": False}}


@dataclass(frozen=True)
class Spec:
    """Options of a run."""

    format: str = "markdown"
    excludes: tuple[str, ...] = ()
    includes: tuple[str, ...] = ()
    include_languages: tuple[str, ...] = ()
    exclude_languages: tuple[str, ...] = ()
    ignore: str | None = None
    default_excludes: bool = False
    prune: bool = False
    extensions: tuple[tuple[str, str], ...] = ()
    max_bytes: int = 20 * 1024 * 1024
    mask: bool = True
    findings: bool = False
    compress: bool = False
    level: str = "medium"
    keep_threshold: int = 3
    keep_tags: tuple[str, ...] = ()
    whole_document: bool = False
    provenance: tuple[tuple[str, str], ...] = field(default=())

    @classmethod
    def of(cls, preset: str | None = None, **options) -> Spec:
        """Defaults, then a preset, then options; ``provenance`` says where each setting came from."""
        return cls.layered((f"preset {preset}", dict(PRESETS[preset]) if preset else {}), ("option", options))

    @classmethod
    def layered(cls, *layers: tuple[str, dict]) -> Spec:
        """Settings of several named layers, the later over the earlier: defaults, preset, file, command line."""
        known = {f.name for f in fields(cls)} - {"provenance"}
        chosen, came = {}, {}
        for source, options in layers:
            if unknown := set(options) - known:
                raise ValueError(f"unknown settings in {source}: {', '.join(sorted(unknown))}")
            for k, v in options.items():
                chosen[k] = tuple(sorted(v.items())) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v
                came[k] = source
        spec = cls(**chosen, provenance=tuple(sorted(came.items())))
        if spec.format not in render.FORMATS:
            raise ValueError(f"unknown format {spec.format!r}")
        return spec

    @classmethod
    def from_file(cls, path: str, preset: str | None = None, **options) -> Spec:
        """A JSON file, or a YAML file where a YAML library is installed, between the preset and the options."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yml", ".yaml")):
            import yaml

            given = yaml.safe_load(text) or {}
        else:
            import json

            given = json.loads(text)
        return cls.layered((f"preset {preset}", dict(PRESETS[preset]) if preset else {}), (path, given), ("option", options))


def kept(corpus: DataFrame, spec: Spec) -> DataFrame:
    reason = files.skip_reason("path", "content", max_bytes=spec.max_bytes, excludes=spec.excludes, includes=spec.includes, include_languages=spec.include_languages, exclude_languages=spec.exclude_languages, ignore=spec.ignore, default_excludes=spec.default_excludes, prune=spec.prune, custom=dict(spec.extensions))
    return corpus.filter(reason.isNull())


def run(corpus: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """(repo, n, path, chunk) from (file_id, repo, path, content); with ``whole_document`` (part, n, path, chunk).

    A line with a finding is always kept, so that no placeholder stands for one.
    """
    listed = out = kept(corpus, spec)
    if spec.mask or spec.findings or spec.compress:
        out = scan.masked(out, hide=spec.mask)
    if spec.compress:
        out = compress.compressed_in(out.withColumn("issues", F.transform("found", lambda x: F.struct(x["line_no"].alias("line_no"), x["severity"].alias("severity")))), level=spec.level, least=spec.keep_threshold, keep_tags=spec.keep_tags, declare=True, check=True)
    if not spec.findings:
        out = out.drop("found")
    return render.document(out, spec.format, listed=listed) if spec.whole_document else render.chunks(out, spec.format, listed)
