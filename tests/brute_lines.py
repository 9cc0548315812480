"""Character-by-character reading of a tab-separated line, to test the loader against."""


def reasons(line):
    line = line or ""
    if line.endswith("\r"):
        line = line[:-1]
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            out = ""
            while True:
                if i >= n:
                    return {"quoting"}
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        out += '"'
                        i += 2
                        continue
                    i += 1
                    break
                out += line[i]
                i += 1
            if i < n and line[i] != "\t":
                return {"quoting"}
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            out = line[i:j]
            if '"' in out:
                return {"quoting"}
            i = j
        fields.append(out)
        if i >= n:
            break
        i += 1
    if len(fields) != 4:
        return {"columns"}
    why = set()
    if fields[2].strip(" ") not in {"1", "2", "3", "4", "5"}:
        why.add("rating")
    user = fields[0].strip(" ")
    if not (1 <= len(user) <= 12 and all(c in "0123456789" for c in user)):
        why.add("user_id")
    return why
