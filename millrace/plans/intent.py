"""What a request in words asks for: data, data that may not be given out, a change, or administration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Korean and English words of requests, by what they ask for.
HARD = "삭제(?!된|되었|됐) 지워 지우[세라고] 없애 날려 드롭 초기화 비워 폐기 \\bdelete\\b \\bdrop\\b \\btruncate\\b \\binsert\\s+into\\b \\bupdate\\s+\\w+\\s+set\\b \\balter\\s+table\\b".split(" ")
SOFT = "수정 변경 바꿔 바꾸 업데이트 갱신 등록 입력 저장 반영 추가(?!로|적|\\s*로|\\s*적) \\bupdate\\b \\binsert\\b \\bset\\b".split(" ")
PASSIVE = "된 되는 되어 되었 됐 됨 된다 하는 하던 했던 한\\s".split(" ")
SHOWN = "정렬 순서 기준 조건 형식 단위 포맷 컬럼\\s*순 보기 화면 필터 sort order format".split(" ")
READ = "보여 알려 조회 뽑아 출력 가져와 궁금 얼마 몇\\s*건 몇\\s*명 목록 리스트 현황 통계 추이 비중 비율 \\bselect\\b \\bshow\\b \\blist\\b".split(" ")
ADMIN = "\\bpragma\\b \\battach\\b \\bdetach\\b \\bgrant\\b \\brevoke\\b \\bvacuum\\b \\bload_extension\\b 권한\\S*\\s*(?:부여|회수|변경|주[어세]) 계정\\S*\\s*(?:생성|삭제) 백업 복구 덤프".split(" ")
VERBS = "수정 변경 바꿔 바꾸 갱신 업데이트 설정".split(" ")
ASKED = "해\\s*(?:줘|주세요|주시|라|다오) 하라 해라 할래".split(" ")
THINGS = "테이블 레코드 데이터 행 컬럼 필드 값 table row record".split(" ")
#: Weights of what speaks for a change, and from where it counts as one.
OBJECT, TARGET, IMPERATIVE, READ_CUE, PRESENTATION, THRESHOLD = 0.5, 0.4, 0.3, -0.5, -0.4, 0.6


def _any(words: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{w})" for w in words), re.I)


_SOFT = re.compile(f"(?:{'|'.join(SOFT)})(?!{'|'.join(PASSIVE)})", re.I)
_TARGET = re.compile(f"(?:으?로)\\s*(?:{'|'.join(VERBS)})")
_IMPERATIVE = re.compile(f"(?:수정|변경|바꿔|바꾸|업데이트|갱신|추가|등록|입력|저장|반영)\\s*(?:{'|'.join(ASKED)})")


@dataclass
class Intent:
    kind: str = "read"  # read, write, admin or pii
    matched: list[str] = field(default_factory=list)
    score: float = 0.0


def classify(request: str, objects: set[str] = frozenset(), forbidden: set[str] = frozenset()) -> Intent:
    """objects: names of tables and columns; forbidden: names of columns that may not be given out, in lower case."""
    low = request.lower()
    if found := _any(ADMIN).findall(request):
        return Intent("admin", found, 1.0)
    if named := sorted(x for x in forbidden if len(x) >= 3 and x in low):
        return Intent("pii", named, 1.0)
    if found := _any(HARD).findall(request):
        return Intent("write", found, 1.0)
    soft = _SOFT.findall(request)
    if not soft:
        return Intent()
    known = any(x and x.lower() in low for x in {*objects, *THINGS})
    score = OBJECT * known + READ_CUE * bool(_any(READ).search(request)) + PRESENTATION * bool(_any(SHOWN).search(request)) + TARGET * bool(_TARGET.search(request)) + IMPERATIVE * bool(_IMPERATIVE.search(request))
    return Intent("write", soft, min(1.0, score)) if score >= THRESHOLD - 1e-9 else Intent()
