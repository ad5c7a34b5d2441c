"""Files of shared folders, as tasks and source readers see them.

Nothing of this library is imported here: readers of streaming sources run in
processes that do not have it.
"""

from __future__ import annotations

from pyarrow import fs as pafs


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, and the path within it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def listed(fs: pafs.FileSystem, folder: str) -> list[str]:
    """Complete files of a folder, in order of name; none if it is missing."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def publish(fs: pafs.FileSystem, folder: str, name: str, data: bytes) -> None:
    """Write a file that appears under its name when it is complete."""
    fs.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}"
    with fs.open_output_stream(hidden) as out:
        out.write(data)
    fs.move(hidden, f"{folder}/{name}")
