"""Column functions over text and paths; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File kinds by ending, names and folders that are left out; fixed values.
SOURCE = ".py .pyw .js .mjs .cjs .jsx .ts .tsx .java .go .rs .rb .php .c .h .cc .cpp .hpp .cs .swift .kt .kts .scala .lua .r .ex .exs .erl .hrl".split()
TEMPLATE = ".j2 .jinja .jinja2 .tmpl .tpl .hbs .mustache".split()
EXECUTABLE = ".sh .bash .zsh .fish .ps1 .bat .cmd".split()
CONFIG = ".json .toml .yaml .yml .ini .cfg .conf".split()
DOCUMENT = ".md .markdown .rst .rest .adoc .txt".split()
BINARY = ".7z .avi .bmp .bz2 .class .db .dll .dylib .eot .exe .gif .gz .ico .jar .jpeg .jpg .lock .m4a .mov .mp3 .mp4 .o .parquet .pdf .png .pyc .so .tar .ttf .webp .woff .woff2 .xz .zip".split()
FOLDERS = (
    ".git .github .circleci .gitlab .travis .ci ci .buildkite .azure-pipelines .kokoro kokoro appveyor .idea .vscode __pycache__ test tests testing __tests__ spec specs "
    "docs doc documentation docs_src docs-source docs_build docs-build benchmarks benchmark vendor gold golden patch patches third_party node_modules dist build coverage htmlcov "
    "testdata test_data test-data test_resources test-resources test_handcalcs test_module utest stresstest locking_tests language_agnostic_test"
).split()
NAMES = (
    "conftest.py noxfile.py pytest.ini runtests runtests.py run_tests run_tests.py run_tests.sh test test.py test.sh test.ps1 install_test_deps.sh docusaurus.config.js docusaurus.config.ts sidebars.js sidebars.ts gold.py "
    ".editorconfig .pre-commit-config.yaml .pre-commit-config.yml package-lock.json yarn.lock pnpm-lock.yaml cargo.lock composer.lock go.sum pipfile.lock .travis.yml .travis.yaml .gitlab-ci.yml .gitlab-ci.yaml "
    "appveyor.yml appveyor.yaml azure-pipelines.yml azure-pipelines.yaml circle.yml codecov.yml .codecov.yml mkdocs.yml mkdocs.yaml"
).split()
TEST_NAME = r"^(?:test_.+|_?testing|.+[_-]tests?|.+\.test|.+\.spec)(?:\.[^.]+)?$"
TEST_NEEDS = r"^requirements[-_.]tests?(?:\.[^.]+)?$"
TEMPLATE_MARK = r"\{\{|\{%|<%|\$\{[^}]+\}"
#: An e-mail address; a fixed value.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
#: Words that carry no topic, and what a word is; fixed values.
STOP = (
    "and the this that with from into then also please should could would change update make add remove tool invocation result response assistant user complete completed done "
    "修改 调整 然后 这个 那个 需要 可以 进行"
).split()
WORD = r"(\$?[a-z0-9_./\\-]{3,}|[\u4e00-\u9fff]{2,})"
#: Bytes of a file that its kind is told from; a fixed value.
HEAD_BYTES = 8192


def extension(path: Column) -> Column:
    """The last ending in lower case, with its dot, or ''."""
    return F.regexp_extract(F.regexp_replace(F.lower(F.replace(F.trim(path), F.lit("\\"), F.lit("/"))), r"/+$", ""), r"(\.[a-z0-9_+-]+)$", 1)


def normal_path(path: Column) -> Column:
    """Forward slashes, single ones, no leading ./; null for a blank path."""
    p = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+", "/")
    return F.nullif(F.regexp_replace(p, r"^(?:\./)+", ""), F.lit(""))


def clean_path(path: Column) -> Column:
    """A repository path as written, made relative and canonical, or null if it is none (globs, URLs, flags, parents, absolute ones)."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    bad = (
        (F.length(p) == 0) | (F.length(p) > 4096) | p.rlike(r"[\x00\r\n$`*?\[\]{}:]") | p.isin("/dev/null", "dev/null") | p.startswith("-") | p.startswith("~") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)")
    )
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    return F.when(~bad & (F.size(parts) > 0), F.array_join(parts, "/"))


def file_kind(path: Column, content: Column) -> Column:
    """source, runtime_template, executable, configuration, or null for what is left out; the first rule wins."""
    low = F.lower(path)
    parts = F.split(low, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    manifest = (name.startswith("requirements") & suffix.isin("", ".in", ".txt")) | F.array_contains(folders, "requirements")
    head = F.coalesce(F.make_valid_utf8(F.substring(content.cast("binary"), 1, HEAD_BYTES).cast("string")), F.lit(""))
    out = F.when(F.arrays_overlap(folders, F.array(*map(F.lit, FOLDERS))), None).when(name.isin(NAMES) | name.rlike(TEST_NAME) | name.rlike(TEST_NEEDS), None)
    out = out.when(suffix.isin(BINARY) | (suffix.isin(DOCUMENT) & ~manifest) | head.contains("\x00"), None)
    out = out.when(suffix.isin(SOURCE), "source").when(suffix.isin(TEMPLATE), "runtime_template")
    page = F.array_contains(folders, "templates") | F.array_contains(folders, "views") | head.rlike(TEMPLATE_MARK)
    out = out.when((suffix == ".html") & page, "runtime_template").when(suffix == ".html", None)
    out = out.when(suffix.isin(EXECUTABLE) | ((suffix == "") & head.startswith("#!")), "executable")
    return out.when(manifest | suffix.isin(CONFIG), "configuration")


def token_estimate(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up; null counts nothing."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 2) / 3).cast("bigint")


def invocation(content: Column) -> Column:
    """A tool exchange up to its result."""
    return F.split_part(content, F.lit("\n\nTool result:"), F.lit(1))


def tool_input(content: Column) -> Column:
    """The JSON line of an invocation, or null."""
    return F.nullif(F.trim(F.regexp_extract(invocation(content), r"(?s)^[^\n]*\n(.*)$", 1)), F.lit(""))


def words(text: Column) -> Column:
    """The distinct terms of a text in order, in lower case and without stop words: runs of at least three letters, digits
    and marks of names and paths, the parts of these of at least three letters, and runs of two or more Chinese characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))
    whole = F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^[./-]+|[./-]+$", ""))
    stop = F.array(*map(F.lit, STOP))
    kept = F.filter(whole, lambda x: (x != "") & ~F.array_contains(stop, x))
    parts = F.filter(F.flatten(F.transform(kept, lambda x: F.split(x, "[/_.-]+"))), lambda x: F.length(x) >= 3)
    return F.array_sort(F.array_except(F.array_distinct(F.concat(kept, parts)), stop))


def fingerprint(text: Column) -> Column:
    """A failure text with temporary paths, quoted values and numbers masked."""
    t = F.regexp_replace(text, r"/tmp/[^ \n]+", "<tmp>")
    t = F.regexp_replace(t, r"'[^'\n]*'|\"[^\"\n]*\"", "<str>")
    return F.regexp_replace(t, r"[0-9]+", "<n>")


def numbered(text: Column) -> Column:
    """The text with its lines numbered from 1."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(" | "), x)), "\n")


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[REDACTED:EMAIL]")


def typed_keys(text: Column) -> Column:
    """Explicit typed identifiers (task, job, run, ... with a value that holds a digit and more), lower-case type."""
    pat = r"(?i)\b(?:task|job|run|execution|trial|shard)(?:[_ ]+id)?[ \"':=#`-]+([a-z0-9_.-]*[0-9][a-z0-9_.-]*[a-z_.-][a-z0-9_.-]*|[a-z_.-][a-z0-9_.-]*[0-9][a-z0-9_.-]*)"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pat), F.lit(1)))
