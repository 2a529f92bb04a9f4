"""Pages of finished .docx files as PDF, through an installed office program; a tool for looking at results."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile


def office() -> str | None:
    return shutil.which("soffice") or shutil.which("libreoffice")


def docx_to_pdf(path: str, out_dir: str, command: str | None = None, timeout: int = 180) -> str:
    """The PDF's path; the program gets a profile of its own, so that several can run."""
    command = command or office()
    if not command:
        raise RuntimeError("no office program is installed")
    with tempfile.TemporaryDirectory() as profile:
        subprocess.run([command, f"-env:UserInstallation=file://{profile}", "--headless", "--convert-to", "pdf", "--outdir", out_dir, path], check=True, capture_output=True, timeout=timeout)
    return os.path.join(out_dir, os.path.splitext(os.path.basename(path))[0] + ".pdf")


def pdf_to_pngs(path: str, dpi: int = 80) -> list[str]:
    """One PNG for each page, by pdftoppm where that is installed."""
    command = shutil.which("pdftoppm")
    if not command:
        raise RuntimeError("pdftoppm is not installed")
    stem = os.path.splitext(path)[0]
    subprocess.run([command, "-png", "-r", str(dpi), path, stem], check=True, capture_output=True)
    folder = os.path.dirname(stem) or "."
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.startswith(os.path.basename(stem) + "-") and f.endswith(".png"))
