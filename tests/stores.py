"""Small content stores on disk."""

from __future__ import annotations

import hashlib
import os
import sqlite3
import zlib


def sha(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


def database(entries=(), chunks=(), nested=(), schema="2.5") -> bytes:
    db = sqlite3.connect(":memory:")
    db.executescript(
        "CREATE TABLE properties(key TEXT, value TEXT); CREATE TABLE catalog(md5path_1 INTEGER, md5path_2 INTEGER, hash BLOB, flags INTEGER, name TEXT);"
        "CREATE TABLE chunks(md5path_1 INTEGER, md5path_2 INTEGER, offset INTEGER, size INTEGER, hash BLOB); CREATE TABLE nested_catalogs(path TEXT, sha1 TEXT, size INTEGER);"
    )
    if schema is not None:
        db.execute("INSERT INTO properties VALUES('schema', ?)", (schema,))
    db.executemany("INSERT INTO catalog(md5path_1, md5path_2, hash, flags) VALUES(?, ?, ?, ?)", entries)
    db.executemany("INSERT INTO chunks(md5path_1, md5path_2, hash) VALUES(?, ?, ?)", chunks)
    db.executemany("INSERT INTO nested_catalogs(sha1) VALUES(?)", [(x,) for x in nested])
    db.commit()
    return db.serialize()


class Tree:
    """A repository folder: catalogs by name, objects, a manifest."""

    def __init__(self, folder):
        self.folder = str(folder)
        self.data = f"{self.folder}/data"
        os.makedirs(self.data, exist_ok=True)

    def put(self, full_hash: str, content: bytes = b"content") -> str:
        os.makedirs(f"{self.data}/{full_hash[:2]}", exist_ok=True)
        path = f"{self.data}/{full_hash[:2]}/{full_hash[2:]}"
        with open(path, "wb") as file:
            file.write(content)
        return path

    def catalog(self, name: str, entries=(), chunks=(), nested=(), schema="2.5", packed=True) -> str:
        content = database(entries, chunks, nested, schema)
        self.put(sha(name) + "C", zlib.compress(content) if packed else content)
        return sha(name)

    def manifest(self, root: str, extra: str = "", tail: str = "") -> None:
        with open(f"{self.folder}/.manifest", "w", newline="") as file:
            file.write(f"C{root}\nB100\n{extra}S7\nNtest\n--\n{tail}")


def blob(name: str) -> bytes:
    return hashlib.sha1(name.encode()).digest()
