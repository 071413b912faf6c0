"""Thresholds and lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROOT = "__root__"

#: CVSS bands, from below; cluster sizes up to which a level holds (fixed values).
CVSS_CRITICAL, CVSS_HIGH, CVSS_MEDIUM = 9.0, 7.0, 4.0
CLUSTER_LOW, CLUSTER_MEDIUM, CLUSTER_HIGH = 2, 5, 10
BLAST_THRESHOLD = 5.0
MAX_PATHS = 10
MAX_PATH_NODES = 10
UNREACHABLE = 1000
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

#: Manifest file names in order of preference; folders that are skipped (fixed values).
MANIFESTS = ("package-lock.json", "package.json", "requirements.txt", "pipfile", "pyproject.toml", "pom.xml")
SKIPPED_FOLDERS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build")

#: Sensitive packages by what they give access to (fixed values; names normalised).
SINKS = {
    "file_write": ("fs", "fs_extra", "graceful_fs", "mkdirp", "rimraf", "glob"),
    "network": (
        "axios", "node_fetch", "got", "superagent", "cross_fetch", "isomorphic_fetch", "request", "needle",
        "requests", "httpx", "urllib3", "aiohttp", "httplib2",
    ),
    "credential": ("keytar", "keychain", "dotenv", "python_dotenv", "configparser", "decouple"),
    "crypto": (
        "crypto", "jsonwebtoken", "bcrypt", "argon2", "forge", "node_rsa", "cryptography", "pyjwt", "passlib",
        "paramiko", "pyotp",
    ),
    "database": (
        "pg", "mysql", "mysql2", "sqlite3", "ioredis", "mongoose", "sequelize", "prisma", "typeorm", "knex",
        "sqlalchemy", "pymongo", "redis", "pymysql", "psycopg2", "motor", "tortoise", "peewee",
    ),
}

#: Words in vendor or product that tell the ecosystem, in order of precedence (fixed values).
ECOSYSTEM_HINTS = (
    ("npm", ("node", "nodejs", "npm", "javascript", "js")),
    ("pip", ("python", "pypi", "pip")),
    ("maven", ("apache", "maven", "gradle", "java", "springframework")),
)

#: How each ecosystem's package manager is told to fetch the newest release of a package.
UPGRADES = {"npm": "npm install {}@latest", "pip": "pip install --upgrade {}", "maven": "mvn versions:use-latest-releases -Dincludes={}"}


def sink_table(spark: SparkSession) -> DataFrame:
    """(name, sink_type): the sensitive packages, a table of fixed size."""
    return spark.createDataFrame([(n, t) for t, names in SINKS.items() for n in names], "name string, sink_type string")
